"""The registered queries of the subpackage in SQL for DuckDB, where SQL can express them."""

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, place, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
        FROM documents)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT lines.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), needle AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), placed AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS span
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM needle) WHERE len(w) >= size)
), hit AS (
  SELECT doc_id, i, size, item_id FROM placed JOIN needle USING (size, span)
), counted AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
"""

EMBEDDING_DEDUP = r"""
WITH RECURSIVE unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM unit UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), component AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM link WHERE link.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM component
"""

SUBSTRING_DEDUP = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS span
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY span) AS least FROM windows) WHERE doc_id > least
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM repeated) GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(w) AS n, coalesce(len(places), 0) AS n_gone,
         CASE WHEN places IS NULL THEN w
              ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(places, p)), lambda p: w[p]) END AS words
  FROM doc LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_gone AS BIGINT) AS n_removed, sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept
"""

# Vectors and centroids as rows (id, dimension, value); a round is one nearest search and one floored mean.
CLUSTER_ROUND = """,
distance_{i} AS (
  SELECT vec_id, number, sum((part.x - c.x) * (part.x - c.x)) AS d
  FROM part JOIN centroid_{i} c USING (dim) GROUP BY vec_id, number
), nearest_{i} AS (
  SELECT vec_id, number, d FROM distance_{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, number) = 1
), mean_{i} AS (
  SELECT number, dim, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS HUGEINT) AS x
  FROM part JOIN nearest_{i} USING (vec_id) GROUP BY number, dim
), centroid_{j} AS (
  SELECT number, dim, coalesce(mean_{i}.x, c.x) AS x FROM centroid_{i} c LEFT JOIN mean_{i} USING (number, dim)
)"""


def centroid_clustering(rounds: int = 5) -> str:
    start = """
WITH kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), part AS (
  SELECT vec_id, unnest(range(1, 65)) AS dim, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x FROM kept
), centroid_0 AS (
  SELECT number, dim, x
  FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS number FROM kept QUALIFY number < 40)
  JOIN part USING (vec_id)
)"""
    steps = "".join(CLUSTER_ROUND.format(i=i, j=i + 1) for i in range(rounds + 1))
    return f"""{start}{steps},
digest AS (
  SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM centroid_{rounds} GROUP BY number
)
SELECT vec_id, CAST(number AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY number) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM nearest_{rounds} JOIN digest USING (number)
"""


def _merkle_level(tree: str, i: int) -> str:
    """Nodes of level i with their siblings, and the nodes of the level above; a lone node goes up as it is."""
    run = "PARTITION BY g, place // 8 ORDER BY place ROWS BETWEEN"
    return f""",
{tree}_side_{i} AS (
  SELECT g, place, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {tree}_{i})
), {tree}_{i + 1} AS (
  SELECT g, place // 8 AS place, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE min(h) END AS h
  FROM {tree}_{i} JOIN (SELECT g, count(*) AS n FROM {tree}_{i} GROUP BY g) USING (g) GROUP BY g, place // 8
)"""


def _merkle_fold(tree: str, i: int, step: int) -> str:
    """One step of all documents up from level i of a tree."""
    return f""",
fold_{step + 1} AS (
  SELECT doc_id, f.g, place_of // 8 AS place_of, siblings || before || behind AS siblings,
         CASE WHEN n > 1 THEN sha256(before || folded || behind) ELSE folded END AS folded
  FROM fold_{step} f JOIN {tree}_side_{i} s ON s.g = f.g AND s.place = f.place_of
)"""


def merkle_manifest(levels: int = 7, group_levels: int = 3) -> str:
    """Trees of up to 8^levels documents a language and 8^group_levels languages."""

    def part(value: str) -> str:
        return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    before_text = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    byte_step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {byte_step}), 4294967295)"
    up = "".join(_merkle_level("leaf", i) for i in range(levels))
    across = "".join(_merkle_level("sub", i) for i in range(group_levels))
    steps = "".join(_merkle_fold("leaf", i, i) for i in range(levels))
    turn = f""",
fold_{levels + 1} AS (SELECT doc_id, 0 AS g, g AS place_of, siblings, folded FROM fold_{levels})"""
    steps += turn + "".join(_merkle_fold("sub", i, levels + 1 + i) for i in range(group_levels))
    last = levels + 1 + group_levels
    return f"""
WITH doc AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         sha256({before_text} || {part("text")}) AS h, sha256({before_text} || {part(lowered)}) AS changed, {crc} % 3 = 0 AS tampered
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS place FROM doc
), leaf_0 AS (SELECT g, place, h FROM placed){up},
sub_0 AS (SELECT 0 AS g, g AS place, h FROM leaf_{levels}){across},
fold_0 AS (
  SELECT doc_id, g, place AS place_of, '' AS siblings, CASE WHEN tampered THEN changed ELSE h END AS folded FROM placed
){steps}
SELECT doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM placed p JOIN fold_{last} USING (doc_id) JOIN sub_0 s ON s.place = p.g, sub_{group_levels} r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": LINE_DEDUP,
        "op6_embedding_dedup": EMBEDDING_DEDUP,
        "op9_decontamination": DECONTAMINATION,
        "op11_substring_dedup": SUBSTRING_DEDUP,
        "op12_centroid_clustering": centroid_clustering(),
        "op13_merkle_manifest": merkle_manifest(),
    }
