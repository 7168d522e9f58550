"""The event data model: column lists, types and fixed vocabularies."""

from pyspark.sql import types as T

# They must equal the published data dictionary for results to line up.
META_COLS = ["recv_timestamp", "host_ip", "session", "record_id"]
COMMON_COLS = ["EventID", "event_name", "computer", "UtcTime", "RuleName", "ProcessGuid", "ProcessId", "Image", "User"]
PROCESS_COLS = [
    "CommandLine", "CurrentDirectory", "Hashes", "LogonGuid", "LogonId", "TerminalSessionId", "IntegrityLevel",
    "FileVersion", "Description", "Product", "Company", "OriginalFileName", "ParentProcessGuid", "ParentProcessId",
    "ParentImage", "ParentCommandLine", "ParentUser",
]
NETWORK_COLS = [
    "Protocol", "Initiated", "SourceIsIpv6", "SourceIp", "SourceHostname", "SourcePort", "SourcePortName",
    "DestinationIsIpv6", "DestinationIp", "DestinationHostname", "DestinationPort", "DestinationPortName",
]
FILE_COLS = ["TargetFilename", "CreationUtcTime", "IsExecutable", "Archived", "Device"]
WINDOWS_COLS = [
    "TargetObject", "EventType", "Details", "NewName", "PreviousCreationUtcTime", "ImageLoaded", "Signature",
    "SignatureStatus", "Signed", "SourceImage", "SourceProcessGuid", "TargetImage", "TargetProcessGuid",
    "GrantedAccess", "CallTrace", "StartAddress", "StartFunction", "StartModule", "NewThreadId", "QueryName",
    "QueryStatus", "QueryResults", "PipeName",
]
DERIVED_COLS = ["parent_known", "label"]
ENRICH_COLS = ["platform", "enriched", "enrich_method", "ancestor_depth", "root_image"]
LABEL_COLS = ["label_method", "is_seed"]
PARSED_COLS = META_COLS + COMMON_COLS + PROCESS_COLS + NETWORK_COLS + FILE_COLS + WINDOWS_COLS + DERIVED_COLS
EVENT_COLS = PARSED_COLS + ENRICH_COLS + LABEL_COLS + ["run_id"]

# Names and kinds of events, inherited and trace columns.
EVENT_NAMES = {
    1: "ProcessCreate", 2: "FileCreateTime", 3: "NetworkConnect", 5: "ProcessTerminate", 6: "DriverLoad",
    7: "ImageLoad", 8: "CreateRemoteThread", 9: "RawAccessRead", 10: "ProcessAccess", 11: "FileCreate",
    12: "RegistryAddDelete", 13: "RegistrySetValue", 14: "RegistryRename", 15: "FileCreateStreamHash",
    16: "SysmonConfigChange", 17: "PipeCreated", 18: "PipeConnected", 22: "DnsQuery", 23: "FileDelete",
}
INTERNAL_EVENT_ID = 255  # the sensor's own error messages, never telemetry
FEATURE_EVENT_IDS = [1, 2, 3, 4, 5, 8, 9, 11, 12, 13, 23]
WINDOWS_ONLY_EVENT_IDS = [2, 6, 7, 8, 10, 12, 13, 14, 15, 17, 18, 19, 20, 21, 22, 24, 25, 26]
NULL_GUID = "{00000000-0000-0000-0000-000000000000}"
INHERIT_COLS = [
    "CommandLine", "CurrentDirectory", "Hashes", "LogonGuid", "LogonId", "TerminalSessionId", "IntegrityLevel",
    "ParentProcessGuid", "ParentProcessId", "ParentImage", "ParentCommandLine", "ParentUser",
]
TRACE_COLS = ["record_id", "recv_timestamp", "UtcTime"]

# Columns that would leak the label, the machine or the run into a model.
LEAKY_COLS = [
    "computer", "host_ip", "session", "recv_timestamp", "record_id", "ProcessGuid", "LogonGuid",
    "ParentProcessGuid", "UtcTime", "CreationUtcTime", "root_image",
]
DROP_BEFORE_FIT = [
    "recv_timestamp", "record_id", "session", "run_id", "computer", "host_ip", "ProcessGuid", "LogonGuid",
    "ParentProcessGuid", "UtcTime", "CreationUtcTime", "root_image", "is_seed", "label_method", "enrich_method",
]
IDENTITY_DROP = [
    "Image", "ProcessId", "ProcessGuid", "ParentProcessGuid", "UtcTime", "computer", "host_ip", "recv_timestamp",
]
BOOKKEEPING_DROP = [
    "record_id", "session", "run_id", "platform", "label", "label_method", "is_seed", "enrich_method", "root_image",
    "LogonGuid", "CreationUtcTime", "family",
]
DERIVED_DROP = ["ancestor_depth", "depth", "enriched", "parent_known", "img_len", "CurrentDirectory"]

# The 32 whole-process features and the 21 behaviour features, in output order.
PROCESS_FEATURES = (
    ["n_events"]
    + [f"{kind}_{e}" for e in FEATURE_EVENT_IDS for kind in ("ev", "frac")]
    + ["n_files", "n_dst_ip", "n_dst_port", "n_regobj", "n_device", "dur_s", "rate", "cmd_len", "pcmd_len"]
)
BEHAVIOUR_FEATURES = [
    "b_sensitive", "b_fname_ent_mean", "b_fname_ent_max", "b_n_ext", "b_ext_conn", "b_create_then_delete",
    "b_children", "b_pipes", "b_redirects", "b_chain", "b_url", "b_ip_literal", "b_b64", "b_devtcp",
    "b_cmd_entropy", "b_exec_writable", "b_sib_spawned", "b_sib_same_image", "b_sib_images", "b_sib_period_cv",
    "b_sib_period_s",
]
# Behaviour that exists the same way on both operating systems (fixed values).
NEUTRAL_FEATURES = [
    "n_events", "dur_s", "rate", "ev_1", "ev_3", "ev_5", "ev_11", "ev_23", "n_files", "n_dst_ip", "n_dst_port",
    "b_sensitive", "b_fname_ent_mean", "b_fname_ent_max", "b_n_ext", "b_ext_conn", "b_create_then_delete",
    "b_children", "b_pipes", "b_redirects", "b_url", "b_ip_literal", "b_b64", "b_exec_writable", "b_sib_spawned",
    "b_sib_same_image", "b_sib_images", "b_sib_period_cv", "b_sib_period_s",
]

RUN_KEY = ["platform", "run_id"]
PROCESS_KEY = ["platform", "run_id", "ProcessGuid"]

_TYPES = {
    "EventID": T.IntegerType(), "record_id": T.LongType(), "UtcTime": T.TimestampType(),
    "ProcessId": T.IntegerType(), "ParentProcessId": T.IntegerType(), "SourcePort": T.IntegerType(),
    "DestinationPort": T.IntegerType(), "parent_known": T.IntegerType(), "label": T.IntegerType(),
    "enriched": T.IntegerType(), "ancestor_depth": T.IntegerType(), "is_seed": T.IntegerType(),
}


def column_type(name):
    return _TYPES.get(name, T.StringType())


EVENT_SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in EVENT_COLS])
