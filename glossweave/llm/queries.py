"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from .decontaminate import op1_winnowing
from .fm_dedup import op3_fm_index
from .html_extract import op9_tag_path_ratios
from .jaccard import op6_divide_skip
from .langid import op4_viterbi
from .mixing import op7_sainte_lague
from .ngram_lm import op5_backoff_automaton
from .search import op10_block_max_wand
from .suffix_dedup import op2_suffix_array
from .toxicity import op8_ftrl

QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_suffix_array": op2_suffix_array,
    "op3_fm_index": op3_fm_index,
    "op4_viterbi": op4_viterbi,
    "op5_backoff_automaton": op5_backoff_automaton,
    "op6_divide_skip": op6_divide_skip,
    "op7_sainte_lague": op7_sainte_lague,
    "op8_ftrl": op8_ftrl,
    "op9_tag_path_ratios": op9_tag_path_ratios,
    "op10_block_max_wand": op10_block_max_wand,
}

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL = {
    "op3_fm_index": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
least AS (SELECT s, min(doc_id) AS m FROM windows GROUP BY s),
late AS (SELECT r, i FROM windows JOIN least USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, p FROM late, unnest(range(i, i + 13)) AS t(p)),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
kept AS (SELECT d.r, array_to_string(list(w[t.p] ORDER BY t.p), ' ') AS s FROM d, unnest(range(1, len(w) + 1)) AS t(p) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = d.r AND gone.p = t.p) GROUP BY d.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r) LEFT JOIN kept USING (r)
""",
    "op1_winnowing": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_PLAIN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_PLAIN}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT r, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
per AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
its AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per USING (r) LEFT JOIN its USING (r)
""",
}
