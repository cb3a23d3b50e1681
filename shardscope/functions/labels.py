"""Class labels derived from relative paths, and the fixed class list of the model table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class codes of the model table, in code order.
MODEL_CLASSES = [
    "benign",
    "bruteForce",
    "ddos_tcp_ddos",
    "pfcp_session_deletion",
    "pfcp_session_establishment",
    "pfcp_session_modification",
]

# Classes that count as session-protocol attacks.
PFCP_CLASSES = ["pfcp_session_deletion", "pfcp_session_establishment", "pfcp_session_modification"]

# Labels held by each of the four simulated clients.
CLIENT_LABELS = {
    "client_1": ["benign", "bruteForce"],
    "client_2": ["benign", "ddos_slowloris"],
    "client_3": ["benign", "ddos_tcp_ddos", "pfcp_session_deletion"],
    "client_4": [
        "benign",
        "pfcp_session_deletion",
        "pfcp_session_establishment",
        "pfcp_session_modification",
    ],
}

# Label left out of the model table, and the client names kept afterwards.
DROPPED_LABEL = "ddos_slowloris"
CLIENT_RENAMES = {"client_1": "client_1", "client_3": "client_2", "client_4": "client_3"}

# Path fragments tested in this order, per top folder.
PATH_RULES = {
    "ddos": [("slowloris", "ddos_slowloris"), ("tcp", "ddos_tcp_ddos")],
    "pfcp": [
        ("session_deletion", "pfcp_session_deletion"),
        ("session_establishment", "pfcp_session_establishment"),
        ("session_modification", "pfcp_session_modification"),
    ],
}
WHOLE_FOLDERS = {"benign": "benign", "bruteforce": "bruteForce"}


def label_from_path(path: Column) -> Column:
    """Label of a file from its path relative to the data folder.

    The first path part chooses the family, the second part (a folder, or the file itself) the
    variant. An empty path is ``unknown``; a family without rules is its own lower-cased name.
    """
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    top = F.lower(F.get(parts, F.lit(0)))
    variant = F.coalesce(F.lower(F.get(parts, F.lit(1))), F.lit(""))
    label = F.when(top.isNull(), F.lit("unknown"))
    for folder, name in WHOLE_FOLDERS.items():
        label = label.when(top == folder, F.lit(name))
    for folder, rules in PATH_RULES.items():
        for fragment, name in rules:
            label = label.when((top == folder) & variant.contains(fragment), F.lit(name))
    return label.otherwise(top)
