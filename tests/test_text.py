"""Literal cases for text functions and rules."""

import pytest
from pyspark.sql import functions as F

from hosttrace.functions import rules, text
from hosttrace.functions.numeric import parse_time, wilson


def values(spark, rows, schema, **cols):
    df = spark.createDataFrame(rows, schema)
    return df.select(*[c.alias(n) for n, c in cols.items()]).collect()


# One case for each launcher form, nesting, and what only looks like a launcher.
UNWRAP = [
    ("bash -c 'cat /etc/hosts'", "cat /etc/hosts"), ("/usr/bin/dash -c ls -l /srv", "ls -l /srv"),
    ('cmd.exe /c dir D:\\data', "dir D:\\data"), ("cmd /c \"bash -c 'date'\"", "date"),
    ('"powershell.exe" & {Get-Date}', "Get-Date"), ("python3 job.py -c config.ini", "python3 job.py -c config.ini"),
    ("bashful -c x", "bashful -c x"), ("", ""), (None, None),
]


def test_unwrap(spark):
    got = values(spark, [(a,) for a, _ in UNWRAP], "c string", out=text.unwrap_command(F.col("c")))
    assert [r.out for r in got] == [b for _, b in UNWRAP]


def test_entropy(spark):
    got = values(spark, [("aaaa",), ("ab",), ("",), (None,)], "c string", e=text.entropy(F.col("c")))
    assert [r.e for r in got] == pytest.approx([0, 1, 0, 0])


# By rule: engine, helper, console host, child of the engine, shell under the engine, and plain activity.
HARNESS = [
    ("/opt/microsoft/pwsh", "pwsh -c Invoke-AtomicTest T9999", "", True),
    ("/bin/bash", "bash run_atomic.sh T9999 1", "", True),
    ("/bin/sleep", "sleep 30", "", True), ("/bin/sleep", "sleep 30 && reboot", "", False),
    (r"D:\apps\conhost.exe", "conhost 0x4", "", True),
    ("/bin/uname", "uname -r", "pwsh -c Invoke-AtomicRedTeam", True),
    ("/bin/bash", "bash -c 'uname -r'", "pwsh -c Invoke-AtomicRedTeam", False),
    ("/usr/bin/tar", "tar czf /tmp/a.tgz /home", "", False), (None, None, None, False),
]


def test_harness(spark):
    got = values(spark, [h[:3] for h in HARNESS], "i string, c string, p string",
                 h=rules.harness_mask(F.col("i"), F.col("c"), F.col("p")))
    assert [r.h for r in got] == [h[3] for h in HARNESS]


def test_clean_value_order(spark):
    got = values(spark, [(" &amp;quot;a&lt;b&#13;&#10; ",), ("-",), ("",), ("x-",)], "c string",
                 v=text.clean_value(F.col("c")))
    assert [r.v for r in got] == ['"a<b', None, None, "x-"]


def test_formula_safe(spark):
    got = values(spark, [("=1+1",), (" +1",), ("@cmd",), ("normal.exe",)], "c string", v=text.formula_safe(F.col("c")))
    assert [r.v for r in got] == ["'=1+1", "' +1", "'@cmd", "normal.exe"]


def test_evidence_order(spark):
    rows = [
        ("/usr/bin/curl", "curl http://x/y", "", "", ""), ("/bin/x", "", "crontab -l", "", ""),
        ("/bin/x", "", "crontab -l", "/var/log/a", ""), ("/bin/x", "", "", "", r"HKLM\CurrentVersion\Run\a"),
        ("/bin/x", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "Image string, CommandLine string, ParentCommandLine string, "
                                     "TargetFilename string, TargetObject string")
    got = rules.with_evidence(df).select("tier", "technique", "evidence").collect()
    assert [tuple(r) for r in got] == [
        ("DIRECT", "T1105 Ingress Tool Transfer", "CommandLine=curl http://x/y"),
        ("PARENT", "T1053.003 Cron", "ParentCommandLine=crontab -l"),
        ("OSBOOK", "Linux runtime/cache", "TargetFilename=/var/log/a"),
        ("DIRECT", "T1547.001 Registry Run Keys", r"TargetObject=HKLM\CurrentVersion\Run\a"), ("none", "", "")]
    assert len(rules.DIRECT) == 32 and len(rules.OSBOOK) == 6 and len(rules.TACTICS) == 22


def test_times_and_wilson(spark):
    rows = [("2026-01-02 03:04:05.678",), ("2026-01-02T03:04:05Z",), ("2026-01-02 03:04:05.123456789",), ("nope",)]
    got = values(spark, rows, "c string", t=F.unix_micros(parse_time(F.col("c"))))
    base = 1767323045_000000
    assert [r.t for r in got] == [base + 678000, base, base + 123456, None]
    low, high = wilson(F.lit(8), F.lit(10))
    r = values(spark, [(1,)], "x int", lo=low, hi=high)[0]
    assert (round(r.lo, 3), round(r.hi, 3)) == (0.490, 0.943)


def test_entropy_of_long_texts(spark):
    """Counted in one walk, the entropy of whole documents is that of short texts; characters are code points."""
    import math
    texts = [None, "", "a", "aab", "\U0001F600é \n\u0000a" * 3, "word " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, found, short in df.select("t", text.entropy(F.col("t"), long=True), text.entropy(F.col("t"))).collect():
        shares = [t.count(c) / len(t) for c in set(t or "")]
        assert found == pytest.approx(-sum(p * math.log2(p) for p in shares), abs=1e-9) == pytest.approx(short, abs=1e-9)
