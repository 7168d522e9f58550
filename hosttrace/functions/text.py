"""Column functions over text: cleaning, paths, entropy and command-line structure. All but the entropy of long texts stay in the JVM."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# XML entities in the order they are undone. `&amp;` before `&quot;` means `&amp;quot;` unescapes twice.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", ""), ("&#10;", " "),
]

# Indicator patterns.
SENSITIVE = (
    r"(?i)/etc/(passwd|shadow|sudoers|crontab|cron\.|systemd/)|/\.ssh/|/\.(bashrc|profile|bash_profile)\b"
    r"|/var/spool/cron|lsass|\\SAM\b|\\CurrentVersion\\Run|\\Startup\\|\\Tasks\\"
    r"|\\Winlogon\\|\\Image File Execution Options\\"
)
WRITABLE = r"(?i)^(/tmp/|/var/tmp/|/dev/shm/)|\\(Temp|AppData|Downloads)\\"
PRIVATE_IP = r"^(10\.|127\.|192\.168\.|172\.(1[6-9]|2\d|3[01])\.|169\.254\.|::1|fe80:|0\.0\.0\.0)"
LAB_IP = r"^(192\.168\.|127\.)"
BASE64_RUN = r"[A-Za-z0-9+/]{24,}={0,2}"
URL = r"(?i)https?://|ftp://"
IPV4 = r"\b\d{1,3}(\.\d{1,3}){3}\b"
DEV_TCP = r"/dev/(tcp|udp)/"

# Launcher wrappers, tried in this order; group 1 is the command that really runs.
_POWERSHELL = (
    r'^\s*"?(?:[A-Za-z]:\\[^"]*\\)?(?:powershell|pwsh)(?:\.exe)?"?\s+'
    r'(?:-(?!c\b|command\b)\w+(?:\s+(?!-)[^\s"&{]+)?\s+)*'
)
LAUNCHERS = [
    r"(?is)" + _POWERSHELL + r"&\s*\{(.*)\}\s*$",
    r"(?is)" + _POWERSHELL + r'-(?:c|command)\s+"?(.*?)"?\s*$',
    r'(?is)^\s*"?(?:[A-Za-z]:\\[^"]*\\)?cmd(?:\.exe)?"?\s+/[ck]\s+"?(.*?)"?\s*$',
    r"""(?s)^\s*(?:/\S*/)?(?:ba|da)?sh\s+-c\s+['"]?(.*?)['"]?\s*$""",
]
LAUNCHER_DEPTH = 3


def clean_value(c):
    """Undo entities in their fixed order, trim, and turn '' and '-' into NULL."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(~trimmed.isin("", "-"), trimmed)


@F.pandas_udf(DoubleType())  # a type by name would need a session at import
def _counted_entropy(texts: pd.Series) -> pd.Series:
    def one(value):
        if not value:
            return 0.0
        n = np.bincount(np.frombuffer(value.encode("utf-32-le"), "<u4"))
        p = n[n > 0] / len(value)
        return float(-(p * np.log2(p)).sum()) + 0.0
    return texts.map(one).astype("float64")


def entropy(c, long=False):
    """Shannon entropy of the characters in bits; NULL and '' give 0.

    Short texts are searched once for each of their characters; ``long`` ones are counted in one walk, in Python.
    """
    if long:
        return _counted_entropy(c)
    n = F.length(c).cast("double")

    def term(total, ch):
        p = (n - F.length(F.replace(c, ch, F.lit("")))) / n
        return total - p * F.log2(p)

    chars = F.array_remove(F.array_distinct(F.split(c, "")), "")
    return F.when(F.length(c) > 0, F.aggregate(chars, F.lit(0.0), term)).otherwise(F.lit(0.0))


def last_part(c):
    """What follows the last slash or backslash."""
    return F.regexp_extract(c, r"([^\\/]*)$", 1)


def basename(c):
    return F.lower(last_part(c))


def extension(c):
    ext = F.lower(F.regexp_extract(last_part(c), r"\.([A-Za-z0-9]{1,8})$", 1))
    return F.when(ext != "", ext)


def unwrap_command(c):
    """Strip launcher syntax, up to three layers deep, so features see the payload and not the tool that ran it."""
    def layer(x, _):
        out = F
        for pattern in LAUNCHERS:
            out = out.when(x.rlike(pattern), F.trim(F.regexp_extract(x, pattern, 1)))
        return out.otherwise(x)

    # The lambda variable stands for each intermediate text, so the expression does not grow with the depth.
    return F.aggregate(F.sequence(F.lit(1), F.lit(LAUNCHER_DEPTH)), c, layer)


def external_ip(c):
    return F.coalesce((c != "") & ~c.rlike(PRIVATE_IP), F.lit(False))


def outside_lab_ip(c):
    return F.coalesce((c != "") & ~c.rlike(LAB_IP), F.lit(False))


def sensitive(*cols):
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(c.rlike(SENSITIVE), F.lit(False))
    return hit


def flag(condition):
    """A condition as 0/1, NULL counting as 0."""
    return F.when(condition, 1).otherwise(0)


def command_structure(cmd, image):
    """Nine command-line and image features fixed at process creation."""
    c = F.coalesce(cmd, F.lit(""))
    return {
        "b_pipes": F.regexp_count(c, F.lit(r"\|")),
        "b_redirects": F.regexp_count(c, F.lit(r"\d?>>?")),
        "b_chain": F.regexp_count(c, F.lit(r"&&|;|\s&\s")),
        "b_url": flag(c.rlike(URL)),
        "b_ip_literal": flag(c.rlike(IPV4)),
        "b_b64": flag(c.rlike(BASE64_RUN)),
        "b_devtcp": flag(c.rlike(DEV_TCP)),
        "b_cmd_entropy": entropy(c),
        "b_exec_writable": flag(image.rlike(WRITABLE)),
    }


def length_or(c, default):
    return F.coalesce(F.length(c), F.lit(default))


def mask_sample_path(c):
    return F.regexp_replace(c, r"/tmp/[^/\s'\"]+", "/tmp/SAMPLE")


def formula_safe(c):
    """Prefix text that a spreadsheet would run as a formula."""
    return F.when(c.rlike(r"^\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def normal_guid(c):
    g = F.lower(F.trim(c))
    return F.when(g != "", g)


def first_label(domain):
    return F.split_part(domain, F.lit("."), F.lit(1))


def join_sorted(values, sep="|"):
    return F.array_join(F.sort_array(values), sep)


def family(session):
    """Session name to activity family; anything unknown is 'other'."""
    s = F.replace(F.replace(F.lower(session), F.lit("_win"), F.lit("")), F.lit("_real"), F.lit(""))
    out = F.lit("other")
    for name in reversed(["benign", "miner", "ransomware", "trojan", "botnet", "exploit"]):
        out = F.when(s.startswith(name), F.lit(name)).otherwise(out)
    return out


def scenario(session):
    return F.replace(session, F.lit("_win"), F.lit(""))
