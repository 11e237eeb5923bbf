"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .collocations import OP12_SQL, op12
from .decontamination import OP13_SQL, op13
from .line_dedup import op8
from .media import media_clips, op3
from .mixing import OP1_SQL, op1
from .ngram_join import OP6_SQL, op6
from .packing import op4
from .periodic_runs import op11
from .pii import op7
from .quality import op5
from .sharding import op2
from .toxicity import op9
from .vectors import op10


def queries() -> dict:
    return {"op1_mixing": op1, "op2_sharding": op2, "op3_media": op3, "op4_packing": op4, "op5_quality": op5, "op6_ngram_join": op6, "op7_pii": op7, "op8_line_dedup": op8, "op9_toxicity": op9, "op10_vectors": op10,
            "op11_periodic_runs": op11, "op12_collocations": op12, "op13_decontamination": op13, "media_clips": media_clips}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op6_ngram_join": OP6_SQL, "op12_collocations": OP12_SQL, "op13_decontamination": OP13_SQL}
