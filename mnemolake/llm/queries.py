"""The registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from .align import op13_align
from .ann import op6_ann
from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .jaccard_join import OP11_SQL, op11_jaccard_join
from .line_dedup import OP5_SQL, op5_line_dedup
from .mixing import OP4_SQL, op4_mixing
from .near_dedup import op8_near_dedup
from .quality import op9_quality
from .runs import OP12_SQL, op12_runs
from .secret_scan import OP2_SQL, op2_secret_scan
from .token_counts import op7_token_counts
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_line_dedup": op5_line_dedup,
    "op6_ann": op6_ann,
    "op7_token_counts": op7_token_counts,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality": op9_quality,
    "op10_chat_format": op10_chat_format,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_runs": op12_runs,
    "op13_align": op13_align,
}
SQL = {"op1_url_filter": OP1_SQL, "op2_secret_scan": OP2_SQL, "op3_decontaminate": OP3_SQL, "op4_mixing": OP4_SQL, "op5_line_dedup": OP5_SQL, "op10_chat_format": OP10_SQL, "op11_jaccard_join": OP11_SQL, "op12_runs": OP12_SQL}
