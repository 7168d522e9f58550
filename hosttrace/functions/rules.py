"""Rule tables and the Column expressions generated from them."""

from functools import reduce

from pyspark.sql import functions as F

from hosttrace.functions.text import basename

# --- fixed values: evidence rules (technique, columns, pattern), first match wins, case-insensitive ---------------
DIRECT = [
    ("T1547.001 Registry Run Keys", ("TargetObject",),
     r"\\CurrentVersion\\Run(Once)?\\|\\Explorer\\User Shell Folders|\\Winlogon\\(Shell|Userinit)"),
    ("T1053.005 Scheduled Task", ("TargetObject",), r"\\Schedule\\TaskCache\\"),
    ("T1053.005 Scheduled Task", ("CommandLine",), r"\bschtasks(\.exe)?\b"),
    ("T1112 Modify Registry", ("TargetObject",),
     r"\\Policies\\|\\Internet Settings\\|\\PowerShell\\1\\ShellIds|NetWire|Ursnif|\\Zone(Map|s)\\"),
    ("T1036.003 Masquerading", ("TargetFilename", "Image"),
     r"\\(Temp|Roaming|lab_sandbox)\\.*\\?(lsass|taskhostw|svchost|notepad|LSM)\.exe$"),
    ("T1036.003 Masquerading", ("CommandLine",), r"copy\s+\S+\s+\S*(lsass|taskhostw|svchost|notepad|LSM)\.exe"),
    ("T1027 Obfuscated Files", ("CommandLine",),
     r"FromBase64String|-enc(odedcommand)?\s+[A-Za-z0-9+/=]{20,}|\[Text\.Encoding\]"),
    ("T1074.001 Local Data Staging", ("TargetFilename",),
     r"\\(lab_sandbox|Temp)\\.*\.(zip|7z|rar)$|Discovery\.bat$"),
    ("T1087.001 Account Discovery", ("CommandLine",),
     r"\bnet1?(\.exe)?\s+(user|localgroup|accounts)\b|Get-LocalUser|query\s+user"),
    ("T1082 System Info Discovery", ("Image", "CommandLine"),
     r"\\(systeminfo|hostname|ver)\.exe$|\bsysteminfo\b|\bhostname\b|wmic\s+(os|bios|computersystem)"),
    ("T1057 Process Discovery", ("Image", "CommandLine"),
     r"\\tasklist\.exe$|\btasklist\b|wmic\s+process|Get-Process"),
    ("T1083 File Discovery", ("Image", "CommandLine"), r"\\findstr\.exe$|\bdir\b.*\s/s|Get-ChildItem.*-Recurse"),
    ("T1059.001 PowerShell", ("CommandLine",),
     r"powershell(\.exe)?[^\r\n]*\s-(Command|nop|noni|w\s+hidden)|\bIEX\b|Invoke-Expression"),
    ("T1005 Data from Local System", ("CommandLine",), r"Copy-Item[^\r\n]*(Documents|Desktop)"),
    ("T1053.003 Cron", ("TargetFilename",), r"/var/spool/cron/|/etc/cron\.(d|daily|hourly)/"),
    ("T1053.003 Cron", ("CommandLine",), r"\bcrontab\b"),
    ("T1543.002 Systemd Service", ("TargetFilename",),
     r"/etc/systemd/system/[^/]+\.service$|/lib/systemd/system/[^/]+\.service$"),
    ("T1543.002 Systemd Service", ("CommandLine",), r"\bsystemctl\s+(enable|start|daemon-reload)"),
    ("T1546.004 Shell Init Persistence", ("TargetFilename",),
     r"/\.(bashrc|bash_profile|profile|zshrc)$|/etc/profile(\.d/)?"),
    ("T1222.002 File Permission Mod", ("CommandLine",), r"\bchmod\b|\bchown\b|\bchattr\b"),
    ("T1548.001 Setuid/Setgid", ("CommandLine",),
     r"chmod\s+[ugoa]*\+s|\bsetcap\b|chmod\s+[0-7]?[2-7][0-7]{3}"),
    ("T1027 Obfuscated Files", ("CommandLine",), r"base64\s+(-d|--decode)|\bxxd\s+-r|openssl\s+enc"),
    ("T1105 Ingress Tool Transfer", ("CommandLine",), r"\b(curl|wget)\b[^\r\n]*https?://"),
    ("T1070.004 File Deletion", ("CommandLine",), r"\brm\s+-[rf]{1,2}\b|\bshred\b|\bunlink\b"),
    ("T1082 System Info Discovery", ("CommandLine",),
     r"\buname\b|/etc/os-release|\blscpu\b|\bdmidecode\b|\bhostnamectl\b"),
    ("T1057 Process Discovery", ("CommandLine",), r"\bps\s+(aux|-ef)|\bpgrep\b|\btop\s+-b"),
    ("T1033 System Owner Discovery", ("CommandLine",), r"\bwhoami\b|\bid\b\s*$|/etc/passwd"),
    ("T1016/T1049 Network Discovery", ("CommandLine",),
     r"\bifconfig\b|\bip\s+(addr|route)|\bnetstat\b|\bss\s+-|\barp\b"),
    ("T1552.001 Credentials In Files", ("TargetFilename", "CommandLine"),
     r"/\.ssh/id_[a-z]+|/etc/shadow|/\.aws/credentials|/\.docker/config\.json"),
    ("T1496 Resource Hijacking", ("Image", "CommandLine"), r"xmrig|minerd|cpuminer|stratum\+tcp"),
    ("T1059.004 Unix Shell", ("CommandLine",), r"\b(bash|sh|dash)\s+-c\b|\beval\s+|/dev/tcp/"),
    ("T1074.001 Local Data Staging", ("TargetFilename",),
     r"/tmp/[^/]*\.(tar|tar\.gz|tgz|zip|gz)$|lab_sandbox/[^/]*\.(tar|zip|gz)$"),
]
OSBOOK = [
    ("BAM (Background Activity Moderator)", ("TargetObject",), r"\\Services\\bam\\State\\UserSettings\\"),
    ("Compatibility Assistant / CIT", ("TargetObject",), r"\\AppCompatFlags\\|\\Software\\Microsoft\\CIT\\"),
    ("PowerShell startup profile", ("TargetFilename",),
     r"StartupProfileData|__PSScriptPolicyTest_|ModuleAnalysisCache"),
    ("Prefetch", ("TargetFilename",), r"\\Prefetch\\.*\.pf$"),
    ("Linux runtime/cache", ("TargetFilename",), r"^/proc/|^/sys/|^/run/|/\.cache/|/var/log/|^/dev/(pts|null|shm)"),
    ("Shell history", ("TargetFilename",), r"/\.(bash|zsh)_history$"),
]
# Strength of evidence across the events of one process (inside one event the order is DIRECT, OSBOOK, PARENT).
TIER_RANK = {"DIRECT": 3, "PARENT": 2, "OSBOOK": 1, "none": 0}

# Tactic of each technique, and the techniques of discovery.
TACTICS = {
    "T1005": "collection", "T1074": "collection", "T1016": "discovery", "T1033": "discovery", "T1057": "discovery",
    "T1082": "discovery", "T1083": "discovery", "T1087": "discovery", "T1027": "defense_evasion",
    "T1036": "defense_evasion", "T1070": "defense_evasion", "T1112": "defense_evasion", "T1222": "defense_evasion",
    "T1053": "persistence", "T1543": "persistence", "T1546": "persistence", "T1547": "persistence",
    "T1059": "execution", "T1105": "command_and_control", "T1548": "privilege_escalation",
    "T1552": "credential_access", "T1496": "impact",
}
TACTIC_NAMES = sorted(set(TACTICS.values())) + ["other"]
DISCOVERY = ["T1007", "T1012", "T1016", "T1033", "T1049", "T1057", "T1069", "T1082", "T1083", "T1087", "T1518"]

# --- fixed values: processes of a test harness, not of the activity under test ------------------------------------
HARNESS_ENGINE = (
    r"(?i)Invoke-AtomicRedTeam|Invoke-AtomicTest|run_atomic\.sh|ATOMIC_TIMEOUT"
    r"|lab_sandbox[\\/][\w.-]+\.(sh|ps1)\b|_lib\.(sh|ps1)"
    r"|powershell\.exe\"? -Version 5\.1 -s -NoLogo -NoProfile"
    r"|New-Item -ItemType Directory -Path C:\\lab_sandbox"
    r"|/vagrant/scenarios/|update-motd|landscape-sysinfo|^/usr/sbin/sshd -D -R$"
    r"|stream_sysmon\.ps1|LabSysmonStream"
)
HARNESS_HELPER = (
    r"(?i)^(sleep \d+|tail -\d+|true|locale|/usr/bin/locale-check \S+|setsid --wait true"
    r"|date -u \+%Y-%m-%dT%H:%M:%SZ|(sudo )?mkdir -p /tmp/(lab_sandbox|benign_\w+)(/\S*)?"
    r"|\"(powershell|cmd)\.exe\" (& \{\}|/c))\s*$"
    r"|\{\s*exit 0\s*\}\s*else\s*\{\s*exit 1\s*\}|\(\s*EXIT 0\s*\)\s*ELSE\s*\(\s*EXIT 1\s*\)"
)
HARNESS_PARENT = r"(?i)Invoke-AtomicRedTeam|-Version 5\.1 -s -NoLogo"
SHELLS = ["sh", "bash", "dash", "cmd.exe", "powershell.exe", "pwsh"]

SUSPECT_PREFIXES = ["/tmp/", "/dev/shm/", "/var/tmp/", "/run/user/"]
SANDBOX = r"(?i)lab_sandbox"
SANDBOX_COLS = ["Image", "CommandLine", "CurrentDirectory", "ParentImage", "ParentCommandLine", "TargetFilename"]

# --- fixed values: entry points of a published emulation plan and of agent-based exercises ------------------------
PLAN_IMAGE = (
    r"3aka3\.scr|\\windows\\temp\\(python|sdelete64|rar)\.exe|psexesvc\.exe|javamtsup\.exe|hostui\.(exe|bat)"
    r"|wsmprovhost\.exe"
)
PLAN_COMMAND = r"system\.drawing\.bitmap|2016_united_states_presidential_election|kxwn\.lock|hostui\.(exe|bat)"
AGENT_IMAGE = r"\\users\\public\\splunkd\.exe$|\\caldera-agent[^\\]*\.exe$"
SCRIPT_HOSTS = [
    "powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe",
]


def _expand(tier, rules, shown):
    return [(tier, technique, name, "(?i)" + pattern, shown) for technique, names, pattern in rules for name in names]


_PARENT_RULES = [(t, ("ParentCommandLine",), p) for t, names, p in DIRECT if "CommandLine" in names]
# One entry per (rule, column), in the order in which an event is tested.
EVIDENCE_TESTS = [*_expand("DIRECT", DIRECT, 88), *_expand("OSBOOK", OSBOOK, 88),
                  *_expand("PARENT", _PARENT_RULES, 80)]
EVIDENCE_COLS = ["Image", "CommandLine", "ParentCommandLine", "TargetFilename", "TargetObject"]


def evidence_rule(tiers=("DIRECT", "OSBOOK", "PARENT")):
    """Number of the first test the event passes, else NULL. A CASE over integers keeps the generated code small."""
    out = F
    for i, (tier, _, name, pattern, _) in enumerate(EVIDENCE_TESTS):
        if tier in tiers:
            out = out.when(F.col(name).rlike(pattern), i)
    return out


def _of_rule(rule, position):
    return F.try_element_at(F.array(*[F.lit(t[position]) for t in EVIDENCE_TESTS]), rule + 1)


def with_evidence(events):
    """Add tier, technique and the quoted evidence text; tier is 'none' where no rule matches."""
    numbered = events.withColumn("_rule", evidence_rule())
    name = _of_rule(F.col("_rule"), 2)
    value = F.when(name == EVIDENCE_COLS[0], F.col(EVIDENCE_COLS[0]))
    for c in EVIDENCE_COLS[1:]:
        value = value.when(name == c, F.col(c))
    shown = F.substring(value, F.lit(1), _of_rule(F.col("_rule"), 4))
    return numbered.withColumns({
        "tier": F.coalesce(_of_rule(F.col("_rule"), 0), F.lit("none")),
        "technique": F.coalesce(_of_rule(F.col("_rule"), 1), F.lit("")),
        "evidence": F.coalesce(F.concat(name, F.lit("="), shown), F.lit("")),
    }).drop("_rule")


def technique_of(rule):
    return _of_rule(rule, 1)


def tier_rank(tier):
    return F.coalesce(*[F.when(tier == t, F.lit(r)) for t, r in TIER_RANK.items()], F.lit(0))


def tactic(technique):
    return F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in TACTICS.items() for x in kv]), F.substring(technique, 1, 5)),
        F.lit("other"))


def severity(technique):
    t = F.coalesce(technique, F.lit(""))
    discovery = reduce(lambda a, b: a | b, [t.startswith(p) for p in DISCOVERY])
    return (F.when(discovery, "low")
            .when(~t.startswith("T") | t.startswith("T1059"), "medium").otherwise("high"))


def severity_rank(level):
    return F.when(level == "low", 0).when(level == "medium", 1).otherwise(2)


def harness_mask(image, cmd, parent_cmd):
    """True for the test framework's own processes: engine, helpers, console hosts, and engine children that are
    not shells (shells under the engine run the test itself and are kept)."""
    base = basename(F.coalesce(image, F.lit("")))
    cmd, parent_cmd = F.coalesce(cmd, F.lit("")), F.coalesce(parent_cmd, F.lit(""))
    return (cmd.rlike(HARNESS_ENGINE) | cmd.rlike(HARNESS_HELPER) | (base == "conhost.exe")
            | (parent_cmd.rlike(HARNESS_PARENT) & ~base.isin(SHELLS)))


def _any(conditions):
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def seed_match(images=(), commands=(), dirs=()):
    """Image contains (case-sensitive), command contains (case-insensitive), or working directory / image prefix."""
    image, cmd, cwd = F.col("Image"), F.lower("CommandLine"), F.col("CurrentDirectory")
    return _any([image.contains(s) for s in images if s]
                + [cmd.contains(s.lower()) for s in commands if s]
                + [c.startswith(s) for s in dirs if s for c in (cwd, image)])


def plan_root():
    """Entry points of the emulation plan, by image, command line or scripting under a system parent."""
    image, cmd, parent = F.lower("Image"), F.lower("CommandLine"), F.lower("ParentImage")
    scripted = image.endswith("powershell.exe") & (
        parent.endswith("\\control.exe") | parent.endswith("\\wmiprvse.exe"))
    return _any([image.rlike(PLAN_IMAGE), cmd.rlike(PLAN_COMMAND), scripted])


def suspect_path(image):
    return _any([image.startswith(p) for p in SUSPECT_PREFIXES])
