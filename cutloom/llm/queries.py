"""Queries of this subpackage, one for each operator."""

from __future__ import annotations

from cutloom.llm.binary_ids import op5_binary_ids
from cutloom.llm.decontaminate import OP3_SQL, op3_decontamination
from cutloom.llm.exact_topk import OP12_SQL, op12_exact_topk
from cutloom.llm.language import op7_language
from cutloom.llm.media import op10_media
from cutloom.llm.neardup import op9_neardup
from cutloom.llm.packing import op1_packing
from cutloom.llm.quality import op4_quality
from cutloom.llm.spelling import OP13_SQL, op13_spelling
from cutloom.llm.token_counts import op8_token_counts
from cutloom.llm.toolcalls import op6_toolcalls
from cutloom.llm.vector_codes import OP11_SQL, op11_vector_codes
from cutloom.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_binary_ids": op5_binary_ids,
    "op6_toolcalls": op6_toolcalls,
    "op7_language": op7_language,
    "op8_token_counts": op8_token_counts,
    "op9_neardup": op9_neardup,
    "op10_media": op10_media,
    "op11_vector_codes": op11_vector_codes,
    "op12_exact_topk": op12_exact_topk,
    "op13_spelling": op13_spelling,
}
#: All pairs that share a shingle, and whatever they reach.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + least(len(words), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
k AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN k ON k.x = d.doc_id
"""

ORACLE_SQL = {
    "op2_warc": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op9_neardup": OP9_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_exact_topk": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
