"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tabmeter.llm import bisector, debruijn, vectorcodes
from tabmeter.llm.chat import BUDGET, CLOSE, HISTORY_TOKENS, OPEN, TURN_TOKENS
from tabmeter.llm.covertree import COSINE

# Windows follow from prefix sums, so their sizes are sums over turns and repeated turns.
CHAT = f"""
WITH given AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
    SELECT conv_id, role, said,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) AS place,
        len(regexp_extract_all(said, '[^ \\t\\r\\n]+')) + {TURN_TOKENS} AS cost,
        {len(OPEN) + 1 + len(CLOSE)} + length(role || said)
            + length(regexp_replace(role || chr(10) || said, '[^\\\\]', '', 'g'))
            + len(regexp_extract_all(role || chr(10) || said, '</?s>|<[|]|\\[/?INST\\]'))
            + length(role) - length(replace(role, chr(10), '')) AS chars
    FROM given
), marked AS (
    SELECT *, place = 1 AND role = 'system' AS is_system FROM turns
), summed AS (
    SELECT *,
        coalesce(sum(CASE WHEN is_system THEN 0 ELSE cost END) OVER before, 0) AS done,
        max(CASE WHEN is_system THEN cost END) OVER before AS system_cost,
        max(CASE WHEN is_system THEN chars END) OVER before AS system_chars,
        CASE WHEN NOT lag(is_system, 1) OVER ordered THEN lag(cost, 1) OVER ordered END AS cost_1,
        CASE WHEN NOT lag(is_system, 2) OVER ordered THEN lag(cost, 2) OVER ordered END AS cost_2,
        lag(chars, 1) OVER ordered AS chars_1, lag(chars, 2) OVER ordered AS chars_2
    FROM marked
    WINDOW ordered AS (PARTITION BY conv_id ORDER BY place),
        before AS (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), roomy AS (
    SELECT *, greatest(1, {BUDGET - HISTORY_TOKENS} - coalesce(system_cost, 0)) AS room FROM summed
), placed AS (
    SELECT *, done // room AS stretch, NOT is_system AND done % room + cost > room AS crosses FROM roomy
), opened AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, stretch, crosses ORDER BY place) = 1 AS opens FROM placed
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(said)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(said, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) + coalesce(sum(
        coalesce(system_chars, 0)
        + CASE WHEN cost_1 <= {HISTORY_TOKENS} THEN chars_1 ELSE 0 END
        + CASE WHEN cost_1 + cost_2 <= {HISTORY_TOKENS} THEN chars_2 ELSE 0 END
    ) FILTER (opens), 0) AS BIGINT) AS formatted_chars
FROM opened GROUP BY conv_id
"""

# Every pair of a label's vectors; only for small tables.
VECTORS = f"""
WITH RECURSIVE given AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
    SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS size FROM given
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
        AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
        ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND a.size > 0 AND b.size > 0
    WHERE list_dot_product(a.v, b.v) >= {COSINE} * a.size * b.size
), reach(a, b) AS (
    SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT vec_id,
    CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links,
    least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
    vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM given
"""


def _sound(scale: int, width: str) -> str:
    """Kept vectors as rows (rid, vec_id, label, place, x) of integers, places from 0."""
    return f"""
given AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS rid, vec_id, label, embedding AS e FROM embeddings
    WHERE embedding IS NOT NULL AND {width}
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cells AS MATERIALIZED (
    SELECT rid, i AS place, CAST(floor({scale} * CAST(e[i + 1] AS DOUBLE)) AS BIGINT) AS x
    FROM (SELECT rid, e, unnest(range(len(e))) AS i FROM given)
)"""


FLOOR = "CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"


def _clusters() -> str:
    steps = [
        _sound(bisector.SCALE, f"len(embedding) = {bisector.DIMENSIONS}"),
        f"""c0 AS MATERIALIZED (
    SELECT cluster, place, x AS c FROM cells JOIN (
        SELECT rid, row_number() OVER (ORDER BY sha256('{bisector.SEED}:' || vec_id)) - 1 AS cluster FROM given
    ) USING (rid) WHERE cluster < {bisector.CLUSTERS}
)""",
    ]
    for i in range(1, bisector.ROUNDS + 2):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, cluster, distance FROM (
        SELECT rid, cluster, sum((x - c) * (x - c)) AS distance FROM cells JOIN c{i - 1} USING (place) GROUP BY rid, cluster
    ) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1
)""")
        steps.append(f"""c{i} AS MATERIALIZED (
    SELECT cluster, place, coalesce(m, c) AS c FROM c{i - 1} LEFT JOIN (
        SELECT cluster, place, {FLOOR} AS m FROM a{i} JOIN cells USING (rid) GROUP BY cluster, place
    ) USING (cluster, place)
)""")
    last = bisector.ROUNDS + 1
    return "WITH " + ", ".join(steps) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{last} JOIN given USING (rid) JOIN (
    SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256
    FROM c{last - 1} GROUP BY cluster
) USING (cluster)
"""


def _codes() -> str:
    parts, entries = vectorcodes.PARTS, vectorcodes.ENTRIES
    steps = [
        _sound(vectorcodes.SCALE, f"len(embedding) > 0 AND len(embedding) % {parts} = 0"),
        f"""split AS MATERIALIZED (
    SELECT rid, place // (len(e) // {parts}) AS part, place % (len(e) // {parts}) AS place, x
    FROM cells JOIN given USING (rid)
)""",
        f"c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, place, x AS c FROM split WHERE rid <= {entries})",
    ]
    for i in range(1, vectorcodes.ROUNDS + 2):
        steps.append(f"""a{i} AS MATERIALIZED (
    SELECT rid, part, entry, distance FROM (
        SELECT rid, part, entry, sum((x - c) * (x - c)) AS distance
        FROM split JOIN c{i - 1} USING (part, place) GROUP BY rid, part, entry
    ) QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY distance, entry) = 1
)""")
        steps.append(f"""c{i} AS MATERIALIZED (
    SELECT part, entry, place, coalesce(m, c) AS c FROM c{i - 1} LEFT JOIN (
        SELECT part, entry, place, {FLOOR} AS m FROM a{i} JOIN split USING (rid, part) GROUP BY part, entry, place
    ) USING (part, entry, place)
)""")
    last = vectorcodes.ROUNDS + 1
    return "WITH " + ", ".join(steps) + f""", coded AS (
    SELECT rid, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, sum(distance) AS error
    FROM a{last} GROUP BY rid
)
SELECT vec_id, code, CAST(error AS BIGINT) AS error,
    CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{last - 1}) AS codebooks_sha256
FROM coded JOIN given USING (rid)
"""


CLUSTERED = _clusters()
CODED = _codes()


WORDS = "[^ \\t\\n\\x0B\\f\\r]+"

LEADS = ", ".join(f"lead(word, {i}) OVER w" for i in range(1, debruijn.LENGTH))

PASSAGES = f"""
WITH given AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents
), placed AS MATERIALIZED (
    SELECT rid, doc_id, unnest(words) AS word, unnest(range(len(words))) AS i FROM given
), windows AS MATERIALIZED (
    SELECT rid, doc_id, i, lead(i, {debruijn.LENGTH - 1}) OVER w AS last, md5(concat_ws(' ', word, {LEADS})) AS edge
    FROM placed WINDOW w AS (PARTITION BY rid ORDER BY i)
), first AS (
    SELECT edge, min(doc_id) AS doc_id FROM windows WHERE last IS NOT NULL GROUP BY edge
), late AS MATERIALIZED (
    SELECT rid, i FROM windows w JOIN first f USING (edge)
    WHERE last IS NOT NULL AND coalesce(w.doc_id > f.doc_id, f.doc_id IS NOT NULL)
), marked AS (
    SELECT rid, word, i, max(l.i) OVER (PARTITION BY rid ORDER BY p.i) AS window_before
    FROM placed p LEFT JOIN late l USING (rid, i)
), kept AS (
    SELECT rid, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
    FROM marked WHERE coalesce(i - window_before, {debruijn.LENGTH}) >= {debruijn.LENGTH} GROUP BY rid
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(text, '')) AS kept_sha256
FROM given LEFT JOIN kept USING (rid)
"""
