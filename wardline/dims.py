"""Dimension contents. Everything below the line is fixed values: codes, names, limits and word lists in natural order."""

# ---- Fixed values ----
SEVERITIES = ["critical", "warning", "info"]
FINDING_KINDS = ["failed-logon", "password-spray", "account-lockout", "privileged-logon", "service-crash", "app-fault", "app-hang", "bugcheck", "unexpected-shutdown"]
LEVELS = {1: "critical", 2: "error", 3: "warning", 5: "verbose"}

# (provider substring, event ids or None for any at level 1 to 3, category), first match counts.
EVENT_RULES = [
    ("service control manager", [7031, 7034, 7024, 7023, 7000, 7009, 7011, 7022], "service-crash"),
    ("application error", [1000], "app-fault"),
    ("application hang", [1002], "app-fault"),
    ("windows error reporting", [1001], "app-fault"),
    (".net runtime", [1026], "app-fault"),
    ("kernel-power", [41], "unexpected-shutdown"),
    ("eventlog", [6008], "unexpected-shutdown"),
    ("bugcheck", [1001], "unexpected-shutdown"),
    ("kernel-power", [42, 107, 109, 506, 507], "power"),
    ("display", [4101], "driver"),
    ("disk", [7, 11, 15, 51, 153, 154], "disk"),
    ("ntfs", [55, 98, 130, 137], "disk"),
    ("windowsupdateclient", [20, 25, 31], "windows-update"),
    ("kernel-pnp", None, "driver"),
    ("userpnp", None, "driver"),
    ("driverframeworks", None, "driver"),
    ("stornvme", None, "disk"),
    ("storahci", None, "disk"),
    ("driver", None, "driver"),
]

# metric: (unit, scoped, max, hysteresis, category)
METRICS = {
    "cpu": ("%", False, 100, 5, "resource"),
    "cpu_core_max": ("%", False, 100, 5, "resource"),
    "cpu_kernel": ("%", False, 100, 5, "resource"),
    "mem": ("%", False, 100, 3, "resource"),
    "commit": ("%", False, 100, 3, "resource"),
    "handles": ("count", False, 1e8, 1000, "resource"),
    "disk": ("%", True, 100, 2, "resource"),
    "proc_cpu": ("%", True, 100, 5, "resource"),
    "proc_mem": ("MB", True, 2**22, 64, "resource"),
    "proc_threads": ("count", True, 1e6, 10, "resource"),
    "health": ("score", False, 100, 5, "system"),
    "sockets_new": ("/s", False, 1e6, 10, "network"),
    "sockets_total": ("count", False, 1e7, 50, "network"),
    "established": ("count", False, 1e7, 20, "network"),
    "net_in": ("MB/s", True, 1e5, 0.5, "network"),
    "net_out": ("MB/s", True, 1e5, 0.5, "network"),
    "if_util": ("%", True, 100, 10, "network"),
    "if_errors": ("/s", True, 1e6, 1, "network"),
    "svc_auto_stopped": ("count", False, 1e4, 0, "reliability"),
    "svc_down": ("state", True, 1, 0, "reliability"),
}

# (id, metric, op, threshold, seconds, severity)
DEFAULT_RULES = [
    ("cpu-sustained", "cpu", ">", 85, 30, "warning"),
    ("mem-pressure", "mem", ">=", 92, 15, "warning"),
    ("commit-exhaustion", "commit", ">=", 90, 30, "warning"),
    ("disk-low", "disk", ">=", 92, 0, "warning"),
    ("disk-critical", "disk", ">=", 97, 0, "critical"),
    ("socket-burst", "sockets_new", ">", 60, 3, "warning"),
    ("proc-runaway", "proc_cpu", ">", 50, 60, "warning"),
    ("nic-saturation", "if_util", ">", 90, 10, "warning"),
    ("svc-auto-failed", "svc_auto_stopped", ">=", 1, 30, "warning"),
]

LOGON_STATUS = {
    "0xc0000064": "the user name does not exist",
    "0xc000006a": "the user name is correct but the password is wrong",
    "0xc000006d": "bad user name or authentication information",
    "0xc0000234": "the account is currently locked out",
    "0xc0000072": "the account is disabled",
    "0xc000006f": "logon outside the allowed hours",
    "0xc0000070": "logon from a workstation that is not allowed",
    "0xc0000071": "the password has expired",
    "0xc0000193": "the account has expired",
    "0xc0000133": "the clocks of the client and the domain controller are out of sync",
    "0xc0000224": "the user must change the password at next logon",
    "0xc000015b": "the user has not been granted this logon type on this computer",
    "0xc0000413": "the authentication firewall blocked the logon",
    "0xc000005e": "no logon server was available",
}
LOGON_TYPES = {
    "2": "interactive (console)",
    "3": "network (SMB / shared folder)",
    "4": "batch (scheduled task)",
    "5": "service",
    "7": "screen unlock",
    "8": "network clear-text (IIS basic auth)",
    "9": "new credentials (RunAs /netonly)",
    "10": "remote interactive (Remote Desktop)",
    "11": "cached interactive",
}
STOP_CODES = {
    0x0A: "IRQL_NOT_LESS_OR_EQUAL",
    0x19: "BAD_POOL_HEADER",
    0x1A: "MEMORY_MANAGEMENT",
    0x1E: "KMODE_EXCEPTION_NOT_HANDLED",
    0x3B: "SYSTEM_SERVICE_EXCEPTION",
    0x50: "PAGE_FAULT_IN_NONPAGED_AREA",
    0x7A: "KERNEL_DATA_INPAGE_ERROR",
    0x7E: "SYSTEM_THREAD_EXCEPTION_NOT_HANDLED",
    0x7F: "UNEXPECTED_KERNEL_MODE_TRAP",
    0x9F: "DRIVER_POWER_STATE_FAILURE",
    0xC2: "BAD_POOL_CALLER",
    0xD1: "DRIVER_IRQL_NOT_LESS_OR_EQUAL",
    0xEF: "CRITICAL_PROCESS_DIED",
    0x116: "VIDEO_TDR_FAILURE",
    0x124: "WHEA_UNCORRECTABLE_ERROR",
    0x133: "DPC_WATCHDOG_VIOLATION",
    0x139: "KERNEL_SECURITY_CHECK_FAILURE",
    0xC000021A: "STATUS_SYSTEM_PROCESS_TERMINATED",
}
EXCEPTION_CODES = {
    "c0000005": "access violation (the program used memory it does not own)",
    "c0000409": "stack buffer overrun / fail-fast (the program deliberately aborted after detecting corruption)",
    "c0000374": "heap corruption",
    "c00000fd": "stack overflow (endless recursion)",
    "c000001d": "illegal CPU instruction",
    "c0000094": "integer division by zero",
    "e0434352": "unhandled .NET exception",
    "e06d7363": "unhandled C++ exception",
    "80000003": "breakpoint (debug build or assertion)",
    "c0000602": "unknown fail-fast exception",
    "c06d007e": "a required DLL could not be loaded",
    "40000015": "fatal application exit",
}
SYSTEM_MODULES = ["ntdll.dll", "kernelbase.dll", "kernel32.dll", "ucrtbase.dll", "msvcrt.dll", "combase.dll", "user32.dll", "clr.dll", "coreclr.dll", "vcruntime140.dll"]
INTERFACE_KINDS = {6: "ethernet", 71: "wifi", 24: "loopback", 131: "tunnel", 243: "cellular", 244: "cellular", 23: "virtual", 53: "virtual"}
TCP_STATES = {1: "CLOSED", 2: "LISTEN", 3: "SYN_SENT", 4: "SYN_RECEIVED", 5: "ESTABLISHED", 6: "FIN_WAIT1", 7: "FIN_WAIT2", 8: "CLOSE_WAIT", 9: "CLOSING", 10: "LAST_ACK", 11: "TIME_WAIT", 12: "DELETE_TCB"}
BUILTIN_USERS = ["SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON", "LOCAL SYSTEM"]
BUILTIN_DOMAINS = ["NT AUTHORITY", "NT SERVICE", "FONT DRIVER HOST", "WINDOW MANAGER"]
EPHEMERAL_START = 32768
SERVICE_PORTS = [1433, 1521, 3306, 3389, 3478, 5222, 5223, 5228, 5349, 5432, 5938, 6379, 8008, 8080, 8443, 8883, 9000, 9443, 19302]
CLIENT_PROCESSES = (
    "chrome.exe msedge.exe firefox.exe brave.exe opera.exe opera_gx.exe vivaldi.exe iexplore.exe msedgewebview2.exe arc.exe chrome chromium chromium-browse "
    "firefox firefox-bin brave opera vivaldi-bin teams.exe ms-teams.exe slack.exe discord.exe zoom.exe spotify.exe onedrive.exe dropbox.exe googledrivefs.exe "
    "outlook.exe olk.exe thunderbird.exe whatsapp.exe telegram.exe signal.exe code.exe code slack discord spotify zoom teams thunderbird googleupdate.exe "
    "microsoftedgeupdate.exe msedgeupdate.exe updater.exe update.exe wuauclt.exe usoclient.exe mousocoreworker.exe backgroundtaskhost.exe searchapp.exe "
    "searchhost.exe steam.exe steamwebhelper.exe epicgameslauncher.exe officeclicktorun.exe apt apt-get packagekitd snapd unattended-upgr fwupd"
).split()
LEGAL_SUFFIXES = [",", " Co.", " Co ", " Inc", " Ltd", " LLC", " GmbH", " Corporation", " Corp", " S.A.", " AG", " B.V.", " Limited", " Pty", " SRL"]
# (substring of the vendor's name, short name, class), first match counts.
BRANDS = [
    ("raspberry pi", "Raspberry Pi", "sbc"), ("espressif", "Espressif (ESP32/ESP8266)", "iot"), ("apple", "Apple", "mobile"), ("samsung", "Samsung", "mobile"), ("xiaomi", "Xiaomi", "mobile"),
    ("huawei", "Huawei", "mobile"), ("honor device", "Honor", "mobile"), ("oneplus", "OnePlus", "mobile"), ("oppo", "OPPO", "mobile"), ("vivo mobile", "vivo", "mobile"),
    ("motorola mobility", "Motorola", "mobile"), ("guangdong oppo", "OPPO", "mobile"), ("realme", "realme", "mobile"), ("nothing technology", "Nothing", "mobile"), ("google", "Google", "iot"),
    ("amazon", "Amazon", "iot"), ("sonos", "Sonos", "iot"), ("philips lighting", "Philips Hue", "iot"), ("signify", "Philips Hue", "iot"), ("tuya", "Tuya", "iot"), ("shelly", "Shelly", "iot"),
    ("ring llc", "Ring", "iot"), ("ecobee", "ecobee", "iot"), ("nest labs", "Google Nest", "iot"), ("hikvision", "Hikvision", "iot"), ("dahua", "Dahua", "iot"), ("microsoft", "Microsoft", "pc"),
    ("dell", "Dell", "pc"), ("lenovo", "Lenovo", "pc"), ("hewlett packard enterprise", "HPE", "network"), ("hp inc", "HP", "pc"), ("hewlett packard", "HP", "pc"), ("intel corporate", "Intel", "pc"),
    ("intel", "Intel", "pc"), ("realtek", "Realtek", "pc"), ("asustek", "ASUS", "pc"), ("giga-byte", "GIGABYTE", "pc"), ("micro-star", "MSI", "pc"), ("acer", "Acer", "pc"), ("liteon", "Lite-On", "pc"),
    ("azurewave", "AzureWave", "pc"), ("murata", "Murata", "pc"), ("qualcomm", "Qualcomm", "pc"), ("mediatek", "MediaTek", "pc"), ("broadcom", "Broadcom", "pc"), ("nvidia", "NVIDIA", "pc"),
    ("advanced micro devices", "AMD", "pc"), ("vmware", "VMware", "vm"), ("parallels", "Parallels", "vm"), ("xensource", "Xen", "vm"), ("oracle", "Oracle (VirtualBox)", "vm"),
    ("pcs systemtechnik", "VirtualBox", "vm"), ("cisco", "Cisco", "network"), ("tp-link", "TP-Link", "network"), ("netgear", "NETGEAR", "network"), ("ubiquiti", "Ubiquiti", "network"),
    ("aruba", "Aruba", "network"), ("juniper", "Juniper", "network"), ("mikrotik", "MikroTik", "network"), ("routerboard", "MikroTik", "network"), ("d-link", "D-Link", "network"),
    ("zyxel", "Zyxel", "network"), ("linksys", "Linksys", "network"), ("belkin", "Belkin", "network"), ("arris", "ARRIS", "network"), ("technicolor", "Technicolor", "network"),
    ("sagemcom", "Sagemcom", "network"), ("avm audiovisuelles", "AVM FRITZ!Box", "network"), ("fortinet", "Fortinet", "network"), ("palo alto", "Palo Alto Networks", "network"),
    ("sophos", "Sophos", "network"), ("synology", "Synology", "network"), ("qnap", "QNAP", "network"), ("eero", "eero", "network"), ("tenda", "Tenda", "network"), ("canon", "Canon", "printer"),
    ("seiko epson", "Epson", "printer"), ("brother industries", "Brother", "printer"), ("xerox", "Xerox", "printer"), ("lexmark", "Lexmark", "printer"), ("kyocera", "Kyocera", "printer"),
    ("ricoh", "Ricoh", "printer"), ("lg electronics", "LG", "tv"), ("sony interactive", "PlayStation", "console"), ("sony", "Sony", "tv"), ("nintendo", "Nintendo", "console"), ("roku", "Roku", "tv"),
    ("hisense", "Hisense", "tv"), ("tcl", "TCL", "tv"), ("vizio", "VIZIO", "tv"), ("panasonic", "Panasonic", "tv"), ("sharp", "Sharp", "tv"),
]
UPGRADE_SOURCES = ["winget", "msstore"]
UPGRADE_ARGUMENTS = ["--exact", "--silent", "--accept-package-agreements", "--accept-source-agreements", "--disable-interactivity"]
MODEL_NAMES = {
    "iPhone15,2": "iPhone 14 Pro",
    "iPhone15,3": "iPhone 14 Pro Max",
    "iPhone16,1": "iPhone 15 Pro",
    "iPhone16,2": "iPhone 15 Pro Max",
    "iPhone17,1": "iPhone 16 Pro",
    "iPhone17,2": "iPhone 16 Pro Max",
    "iPhone17,3": "iPhone 16",
    "iPhone17,4": "iPhone 16 Plus",
    "MacBookAir10,1": "MacBook Air (M1)",
    "MacBookAir15,2": "MacBook Air (M3, 13-inch)",
    "AppleTV11,1": "Apple TV 4K (2nd generation)",
}
NAME_SOURCES = ["netbios", "mdns", "ssdp", "dns"]
