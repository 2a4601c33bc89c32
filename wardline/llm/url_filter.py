"""URL filter: rules on host and path, then logistic regression on hashed character n-grams of both.

The weights are trained on the driver from a small labelled table of URLs, LABELLED, and reach the plan as one literal array of
BUCKETS numbers; scoring is made of SQL functions alone. Host and path n-grams are hashed by the first four hexadecimal digits of
their MD5 with different prefixes, each URL's counts are divided by its number of n-grams. LABELLED is written by hand in the
manner of public URLs of many kinds; its hosts don't occur in any test table.

Cases: a null url, or one without `://`, has an empty host and path, no rule and the verdict of the model for empty parts. Urls of
any length are judged whole. Rows are independent; repeated rows, null ids and empty tables need no care. Extra columns are left
behind.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, SIZES, RIDGE, ROUNDS = 16384, (3, 4), 3e-6, 60
#: (rule's host, rule's path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

# Labelled URLs without their scheme, to allow and to block.
ALLOWED = """
news.bbc-archive.com/politics/2023/budget-debate
www.dailychronicle.net/
www.morningpost.com.au/business/markets/closing-report
lemonde-regional.fr/culture/cinema/festival
zeitung-heute.de/wissen
elperiodico-local.es/deportes/resultados
docs.python-guide.net/3/library/functions.html
developer.webstandards.org/
manual.database-project.com/current/sql-select.html
wiki.linuxusers.net/index.php/Networking
en.openencyclopedia.com/wiki
fr.openencyclopedia.net/wiki/Histoire_de_la_musique
library.oxbridge.ac.uk/catalogue/records/48213
www.physics.statecollege.edu/
history.uni-freiburg.de/institut/personen
www.nationalmuseum.nl/collection/paintings
gallery.modernart.net/exhibitions
www.metoffice-data.gov.uk/forecast/north-east
www.healthservice.gov/vaccines/schedule
parliament.govt.nz/
www.cityofharbor.gov/permits/building
transit.metroregion.net/timetables/weekday
www.railways.ch/fahrplan
recipes.homekitchen.com/soups/leek-and-potato
www.seasonalcook.net/bread/sourdough-starter
gardening.allotment.com/
blog.woodworker.net/2022/06/dovetail-joints
www.knittingcircle.org/patterns/winter-scarf
forum.cyclists.com/threads
community.photographers.net/topic/lens-reviews
answers.programmers.com/questions/77120/sorting-a-list
github-mirror.net/
lists.kernel-dev.org/archives/2021-March/thread.html
packages.distribution.com/stable/editors
journal.geology.net/articles
arxiv-mirror.com/abs/1905.00123
www.medicaljournal.net/content/348/cardiology
www.weatherwatch.ca/
sports.localpaper.com/football/league-table
www.chessclub.net/tournaments/standings
www.rowingclub.com/events
music.concerthall.at/programme/symphony
www.operahouse.it/stagione/calendario
travel.guidebook.com/
www.hikingtrails.net/routes/alps/map
hotel-seeblick.ch/zimmer/anreise
www.farmersmarket.net/vendors
shop.bookbinder.org/products/linen-cloth
www.hardwarestore.com/catalog/hand-tools/chisels
www.primaryschool.sch.uk/
www.kindergarten-sonne.de/eltern/aktuelles
careers.engineeringfirm.net/jobs/structural-engineer
www.lawlibrary.org/cases
www.statistics.gov.pl/population/tables
data.census-bureau.gov/economy/employment
astronomy.observatory.com/
www.birdwatching.net/species/kingfisher
www.theatre-company.org/plays/season
poetry.foundationpress.com/poems
www.charity-water.net/projects/wells
www.dentalpractice.com/appointments
www.villagechurch.net/
podcasts.publicradio.org/episodes/science-hour
www.localbrewery.com/visit/tours
www.electronics-lab.net/projects
maps.openatlas.com/relation/62422
translate.dictionary.net/english/spanish/house
www.antiquemaps.org/
www.firebrigade.com/prevention/smoke-alarms
www.vetclinic.net/advice/puppies
"""
BLOCKED = """
viagra-without-prescription.com/order
generic-cialis-pills.net/
canadian-pharmacy-online.org/buy/tramadol-discount
rx-meds-direct.com/index.html
cheap-discount-pharmacy.info/products/3
pills4less.net/catalogue
www.buy-xanax-online.com/
weightloss-miracle.org/diet-pill-offer
keto-slim-fast.com/page/2
lose-weight-now.net/
casino-jackpot-bonus.com/signup
royal-slots-casino.net/
vegas-casino-games.org/about
online-poker-bonus.com/play
www.poker-casino.info/en
sportsbetting-tips.com/odds
free-bet-bonus.net/
bets-and-odds.org/today
win-big-roulette.com/play
lucky-slots-win.net/bonus
jackpot-winner.org/claim
xxx-hot-videos.com/watch
free-porn-tube.net/
porn-movies-hd.org/category/12
adult-webcam-girls.com/live
adult-sex-dating.net/
sexy-singles-chat.com/profile/9
hot-nude-pics.org/gallery
nude-celebs-xxx.net/
escort-girls-tonight.com/city
payday-loan-fast.com/apply
bad-credit-loans.net/
easy-cash-advance.org/now
instant-loan-approval.info/form
make-money-fast.com/home
earn-cash-online.net/
free-money-secret.org/offer
earn-bitcoin-daily.com/invest
crypto-profit-doubler.net/
free-gift-card-winner.com/claim
you-won-a-prize.net/
survey-reward-free.org/start
replica-rolex-watches.com/shop
cheap-designer-handbags.net/
fake-luxury-brands.org/sale
cheap-viagra-cialis.org/sale
fake-passport-documents.com/order
warez-crack-download.org/
full-version-crack.net/serial
keygen-free-download.com/file/77
torrent-movies-free.org/top
spam-seo-backlinks.com/buy
cheap-backlinks-spam.net/
buy-followers-likes.org/instagram
hack-account-password.com/tool
secure-login-verify.net/account
paypal-login-update.com/verify
bank-account-verify.org/login
click-here-free-offer.com/
hot-deals-cheap-buy.net/today
"""
LABELLED = [(f"https://{url}", label) for label, table in enumerate((ALLOWED, BLOCKED)) for url in table.split()]


def parts(url: str) -> tuple[str, str]:
    """Host and path in plain Python, for training."""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    at = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, path = rest[:at], rest[at:]
    path = path[: min((k for k in map(path.find, "?#") if k >= 0), default=len(path))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def hashed(host: str, path: str) -> list[int]:
    """The buckets of a URL's n-grams in plain Python, for training."""
    found = []
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in SIZES:
            found += [int(hashlib.md5((kind + text[k : k + n]).encode()).hexdigest()[:4], 16) % BUCKETS for k in range(len(text) - n + 1)]
    return found


def trained(labelled: list[tuple[str, int]]) -> tuple[list[float], float]:
    """Weights of the buckets and the bias, by Newton's method on ridge-penalised logistic regression in the rows' own span."""
    x = np.zeros((len(labelled), BUCKETS))
    for k, (url, _) in enumerate(labelled):
        grams = hashed(*parts(url))
        np.add.at(x[k], grams, 1 / len(grams))
    y = np.array([label for _, label in labelled], dtype=float)
    inner = x @ x.T
    alpha, bias = np.zeros(len(y)), 0.0
    for _ in range(ROUNDS):
        z = inner @ alpha + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        # Solve for the weighted least squares step: (inner + ridge * n / s) alpha + bias = z + (y - p) / s, with sum(alpha) = 0.
        n = len(y)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n] = inner + np.diag(RIDGE * n / s)
        system[:n, n] = system[n, :n] = 1
        solved = np.linalg.solve(system, np.append(z + (y - p) / s, 0))
        alpha, bias = solved[:n], solved[n]
    return [round(float(w), 5) for w in x.T @ alpha], round(float(bias), 5)


@cache
def weights() -> tuple[list[float], float]:
    return trained(LABELLED)


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def _bucket(kind: str, text: Column, n: int):
    return lambda k: (F.conv(F.substring(F.md5(F.concat(F.lit(kind), F.substring(text, k, F.lit(n))).cast("binary")), 1, 4), 16, 10).cast("int") % BUCKETS)


def logit(host: Column, path: Column) -> Column:
    values, bias = weights()
    # One literal that the optimizer folds into an array.
    table = F.split(F.lit(",".join(f"{x:g}" if x == 0 else repr(x) for x in values)), ",").cast("array<double>")
    total, count = F.lit(0.0), F.lit(0)
    for kind, own in (("h", host), ("p", path)):
        text = F.concat(F.lit("^"), own, F.lit("$"))
        for n in SIZES:
            places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
            grams = F.transform(places, _bucket(kind, text, n))
            total = total + F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g))
            count = count + F.size(places)
    return F.lit(bias) + total / F.greatest(count, F.lit(1))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of `block`, for each row."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = out.withColumns({"fit": rule_of(F.col("host"), F.col("path")), "score": 1 / (1 + F.exp(-logit(F.col("host"), F.col("path"))))})
    model = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), model).alias("verdict"), "score")
