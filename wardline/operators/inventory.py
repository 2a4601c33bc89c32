"""Inventory: duplicates, vendors by longest prefix, brands, upgrades by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import dims
from wardline.functions.scalars import iso_date, mac_digits, normalised, product_code, short_name, valid_ip


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """One row per (lower name, version): the first, or the first that isn't of scope `user` if the first is. Hidden where all rows up to that one are."""
    w = Window.partitionBy(F.lower("name"), "version").orderBy(order)
    first_user = F.first("scope").over(w) == "user"
    better = F.min(F.when(F.col("scope") != "user", F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chosen = F.when(first_user, F.coalesce(better, F.first(order).over(w))).otherwise(F.first(order).over(w))
    marked = rows.withColumn("_first", F.first(order).over(w)).withColumn("_chosen", chosen).withColumn("_hidden", F.first("hidden").over(w))
    return marked.where(F.col(order) == F.col("_chosen")).withColumn("hidden", F.when(F.col("_first") == F.col("_chosen"), F.col("hidden")).otherwise(F.col("hidden") & F.col("_hidden"))).drop("_first", "_chosen", "_hidden")


def vendors(devices: DataFrame, registry: DataFrame) -> DataFrame:
    """``vendor`` by the longest of 9, 7 and 6 digits of the MAC; the registry (prefix, organisation) holds tens of thousands of short rows, Spark broadcasts it by its measured size."""
    digits = mac_digits(F.col("mac"))
    out = devices.withColumn("_d", F.when(~digits.isin("0" * 12, "F" * 12), digits))
    for n in (9, 7, 6):
        own = registry.where(F.length("prefix") == n).groupBy(F.col("prefix").alias(f"_p{n}")).agg(F.max("organisation").alias(f"_o{n}"))
        out = out.join(own, F.substring("_d", 1, n) == F.col(f"_p{n}"), "left")
    local = F.conv(F.substring("_d", 2, 1), 16, 10).cast("int").bitwiseAND(2) != 0
    name = F.when(local, F.lit("Random")).otherwise(F.coalesce("_o9", "_o7", "_o6"))
    return out.withColumn("vendor", name).drop("_d", *(f"_{k}{n}" for n in (9, 7, 6) for k in "po"))


def brand(name: Column) -> Column:
    """struct<short, class> of the first brand whose text the name contains."""
    low = F.lower(name)
    out = F.struct(short_name(name).alias("short"), F.lit(None).cast("string").alias("class"))
    for part, short, kind in reversed(dims.BRANDS):
        kind_ = F.when(low.contains("xbox"), "console").otherwise(kind) if short == "Microsoft" else F.lit(kind)
        out = F.when(low.contains(part), F.struct(F.lit(short).alias("short"), kind_.alias("class"))).otherwise(out)
    return out


def upgrades(apps: DataFrame, available: DataFrame) -> DataFrame:
    """Each upgrade with its app: equal normalised names, or one of eight characters or more that begins the other. Of these the last with
    the installed version, else the first. Names of separators alone fit nothing. Blocked on the first eight characters."""
    a = apps.withColumn("_a", normalised(F.col("name")))
    u = available.withColumn("_u", normalised(F.col("upgrade_name"))).where("_u != ''")
    block = F.substring("_a", 1, 8) == F.substring("_u", 1, 8)
    fits = (F.col("_a") == F.col("_u")) | ((F.length("_u") >= 8) & F.col("_a").startswith(F.col("_u")))
    same = F.coalesce(F.col("version") == F.col("current"), F.lit(False))
    w = Window.partitionBy("upgrade_name").orderBy(F.desc(same), F.when(same, -F.col("app_id")).otherwise(F.col("app_id")))
    return u.join(a, block & fits).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_a", "_u", "_r")


def devices(seen: DataFrame, now: Column, ttl_seconds: int = 1800) -> DataFrame:
    """Devices of observations (id, ip, mac, ts) that were seen within ``ttl_seconds``: the latest mac and since when the address has had it without a change."""
    w = Window.partitionBy("ip").orderBy("ts", "id")
    own = seen.withColumn("_c", F.when(~F.col("mac").eqNullSafe(F.lag("mac").over(w)), F.col("ts")))
    out = own.groupBy("ip").agg(F.max_by("mac", F.struct("ts", "id")).alias("mac"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.coalesce(F.max("_c"), F.min("ts")).alias("mac_since"))
    return out.where(F.col("last_seen") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))


def catalogued(raw: DataFrame) -> DataFrame:
    """Raw uninstall entries (display_name, version, publisher, release_type, parent_key, system_component, source, scope, key_name, windows_installer, install_date)
    as apps: those with a name, their kind, whether they are hidden, and where they come from."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    update = F.lower(blank("release_type")).isin("update", "hotfix", "security update", "service pack") | (blank("parent_key") != "")
    kind = F.when(~blank("source").isin("", "registry"), "package").when(update, "update").when(F.col("system_component") == 1, "system-component").otherwise("app")
    out = raw.where(blank("display_name") != "").withColumn("kind", kind)
    return out.withColumns(
        {"name": blank("display_name"), "version": blank("version"), "publisher": blank("publisher"), "hidden": F.col("kind").isin("update", "system-component"), "source": F.coalesce(F.nullif(blank("source"), F.lit("")), F.lit("registry")), "msi": F.coalesce((F.col("windows_installer") == 1) | product_code(F.col("key_name")), F.lit(False)), "install_date": iso_date(blank("install_date"))}
    ).drop("display_name", "release_type", "parent_key", "system_component", "windows_installer", "key_name")


def manifest_apps(apps: DataFrame, specs: list[tuple[str, str, bool]]) -> DataFrame:
    """For each spec (name, text, exact) the version of the first app (by app_id) that has one and whose lower-case name contains the text;
    with ``exact`` it is the text, or begins with it and ` version`."""
    table = F.broadcast(apps.sparkSession.createDataFrame(specs, "spec string, text string, exact boolean"))
    low = F.lower("name")
    fits = F.when(F.col("exact"), (low == F.col("text")) | low.startswith(F.concat(F.col("text"), F.lit(" version")))).otherwise(low.contains(F.col("text")))
    return apps.where("version != ''").join(table, fits).groupBy("spec").agg(F.min_by("version", "app_id").alias("installed"))


def eligible(devices: DataFrame) -> DataFrame:
    """Devices (ip, mac) with a valid address that is neither multicast nor broadcast, and a MAC that isn't multicast."""
    odd = F.conv(F.substring(mac_digits(F.col("mac")), 1, 2), 16, 10).cast("int").bitwiseAND(1) != 0
    return devices.where(valid_ip(F.col("ip")) & ~F.col("ip").rlike(r"^(22[4-9]|23[0-9])\.|^255\.255\.255\.255$|^[fF][fF]") & mac_digits(F.col("mac")).isNotNull() & ~odd)


def attributed(hosts: DataFrame, neighbors: DataFrame, gateways: DataFrame) -> DataFrame:
    """Hosts (ip, if_index, incident_mac) with their neighbour's MAC (on link); else that of the interface's gateway (not on link), else the incident's."""
    near = neighbors.select("ip", F.col("mac").alias("_near"))
    far = gateways.join(neighbors.select(F.col("ip").alias("gateway"), F.col("mac").alias("_far")), "gateway").select("if_index", "_far")
    out = hosts.join(near, "ip", "left").join(far, "if_index", "left")
    on_link = F.col("_near").isNotNull()
    return out.withColumns({"mac": F.coalesce("_near", "_far", "incident_mac"), "on_link": on_link}).drop("_near", "_far")
