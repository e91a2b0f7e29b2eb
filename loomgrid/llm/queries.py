"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from loomgrid.llm.archives import OP4_SQL, op4_warc
from loomgrid.llm.chat import op9_chat
from loomgrid.llm.decontaminate import op2_decontaminate
from loomgrid.llm.fingerprints import op11_fingerprints
from loomgrid.llm.langid import op6_langid
from loomgrid.llm.merkle import OP12_SQL, op12_merkle
from loomgrid.llm.minhash import op7_minhash
from loomgrid.llm.packing import op5_packing
from loomgrid.llm.periods import op13_periods
from loomgrid.llm.pii import op8_pii
from loomgrid.llm.quality import op3_quality
from loomgrid.llm.sitetree import op10_html
from loomgrid.llm.suffixes import op1_repeats

QUERIES = {
    "op1_repeats": op1_repeats,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_langid": op6_langid,
    "op7_minhash": op7_minhash,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_html": op10_html,
    "op11_fingerprints": op11_fingerprints,
    "op12_merkle": op12_merkle,
    "op13_periods": op13_periods,
}
ORACLE_SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op12_merkle": OP12_SQL}
