"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontamination import OP1_SQL, op1
from .exact_dedup import OP7_SQL, op7
from .line_dedup import OP3_SQL, op3
from .near_dedup import op10
from .packing import op8
from .pii import op6
from .token_counts import op5
from .token_store import op2
from .toxicity import op9
from .warc_zip import OP4_SQL, op4

QUERIES = {
    "op1_decontamination": op1,
    "op2_token_store": op2,
    "op3_line_dedup": op3,
    "op4_warc_zip": op4,
    "op5_token_counts": op5,
    "op6_pii": op6,
    "op7_exact_dedup": op7,
    "op8_packing": op8,
    "op9_toxicity": op9,
    "op10_near_dedup": op10,
}

SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_warc_zip": OP4_SQL,
    "op7_exact_dedup": OP7_SQL,
}
