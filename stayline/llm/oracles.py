"""The corpus queries as DuckDB SQL, where SQL can express them."""

OP1 = r"""
WITH RECURSIVE rests AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM rests
), parsed AS (
  SELECT page_id, html, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM split
), rules(verdict, host, path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS MATERIALIZED (
  SELECT p.page_id, p.html, p.host, p.path, r.rule, r.verdict
  FROM parsed p LEFT JOIN LATERAL (
    SELECT host || path AS rule, verdict FROM rules
    WHERE (p.host = rules.host OR suffix(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)
    ORDER BY length(host || path) DESC, host || path DESC LIMIT 1
  ) r ON true
), links AS (
  SELECT host AS source, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target
  FROM (SELECT host, unnest(regexp_extract_all(html,
    '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)) AS target FROM judged)
), edges AS (
  SELECT source, target, count(*) AS n FROM links WHERE source <> '' AND source <> target GROUP BY ALL
), both_ways AS (
  SELECT 'allow' AS kind, source AS a, target AS b, n FROM edges
  UNION ALL SELECT 'block', target, source, n FROM edges
), steps AS MATERIALIZED (
  SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) AS share FROM both_ways
), seeds AS MATERIALIZED (
  SELECT verdict AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY verdict) AS rank
  FROM judged WHERE host <> '' AND verdict IS NOT NULL GROUP BY verdict, host
), bound AS (
  SELECT 0.001::DOUBLE * 0.1 / greatest(count(DISTINCT host), 1) AS least FROM judged WHERE host <> ''
), flows AS (
  SELECT 0 AS step, kind, host, (1 - 0.85::DOUBLE) * rank AS rank FROM seeds
  UNION ALL
  SELECT step + 1, f.kind, s.b, sum(0.85::DOUBLE * s.share * f.rank)
  FROM (SELECT *, sum(rank) OVER () AS moving FROM flows) f JOIN steps s ON s.kind = f.kind AND s.a = f.host
  WHERE moving * (0.85::DOUBLE / (1 - 0.85::DOUBLE)) > (SELECT least FROM bound) GROUP BY step, f.kind, s.b
), ranks AS (
  SELECT host, coalesce(sum(rank) FILTER (kind = 'allow'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'block'), 0) AS distrust
  FROM flows GROUP BY host
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.verdict, CASE WHEN distrust > trust
  AND distrust * (SELECT count(DISTINCT host) FROM judged WHERE host <> '') >= 0.1 THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN ranks USING (host)
"""

OP2 = r"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x : x IS NULL OR NOT isfinite(x)), true)
    AND list_contains(list_transform(embedding, lambda x : x <> 0), true)
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_ids AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM least_ids
"""

OP3 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(text, ''))) AS key
  FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, source_no % 3 + 1 AS weight, 3 * source_size AS cap FROM totals
), levels AS (
  SELECT *, ((SELECT sum(source_size) FROM totals)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((SELECT sum(weight) FROM weighed)
      - coalesce(sum(weight) OVER (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed
), targets AS (
  SELECT *, least((SELECT max(level) FROM levels WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE)) AS target,
    greatest(source_size // 64, 1) AS blocks
  FROM levels
), quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target * blocks / source_size) AS BIGINT) ELSE 0 END AS quota,
    source_size // blocks AS base, source_size % blocks AS longer FROM targets
), ends AS MATERIALIZED (
  SELECT *, sum(quota) OVER (ORDER BY source_no) AS high, sum(quota) OVER () AS slots FROM quotas
), points AS (
  SELECT slot, CAST(CAST(CAST(slot + 1 AS HUGEINT) * 44945570212853 % 72723460248141 AS BIGINT) AS DOUBLE)
    / CAST(72723460248141 AS DOUBLE) AS x
  FROM (SELECT unnest(range(0, 3 * (SELECT CAST(max(slots) AS BIGINT) FROM ends))) AS slot)
), ranked AS (
  SELECT source_no, blocks, quota, row_number() OVER (PARTITION BY source_no ORDER BY slot) - 1 AS rank
  FROM points JOIN ends ON x * CAST(slots AS DOUBLE) >= high - quota AND x * CAST(slots AS DOUBLE) < high
), visits AS (
  SELECT source_no, rank % blocks AS block, count(*) AS visits FROM ranked WHERE rank < quota GROUP BY ALL
), placed AS (
  SELECT s.doc_id, s.size, q.source_no, q.source_size, q.target, q.base, q.longer, q.blocks,
    sum(s.size) OVER (PARTITION BY q.source_no ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size AS start
  FROM sized s JOIN ends q ON s.source IS NOT DISTINCT FROM q.source
), blocks AS (
  SELECT source_no, block, block * base + least(block, longer) AS first,
    (block + 1) * base + least(block + 1, longer) AS next
  FROM (SELECT source_no, base, longer, unnest(range(0, blocks)) AS block FROM ends)
), taken AS (
  SELECT p.source_no, p.start, p.doc_id, sum((least(p.start + p.size, b.next) - greatest(p.start, b.first)) * v.visits) AS taken
  FROM placed p
  JOIN blocks b ON b.source_no = p.source_no AND b.first < p.start + p.size AND b.next > p.start
  JOIN visits v ON v.source_no = b.source_no AND v.block = b.block
  GROUP BY ALL
)
SELECT p.doc_id, p.size, p.source_size, p.target, CAST(coalesce(t.taken, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN taken t ON p.size > 0 AND t.source_no = p.source_no AND t.start = p.start AND t.doc_id = p.doc_id
"""

OP4 = r"""
WITH keyed AS MATERIALIZED (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)), 1, 15) AS BIGINT) AS key
  FROM documents
), nodes AS (
  SELECT doc_id, bytes, key, depth, key >> (60 - depth) AS prefix
  FROM (SELECT *, unnest(range(0, 61)) AS depth FROM keyed)
), sums AS (
  SELECT depth, prefix, sum(bytes) AS shard_bytes, count(*) AS shard_docs FROM nodes GROUP BY depth, prefix
  HAVING sum(bytes) <= 1048576 OR min(key) = max(key) OR depth = 60
), fits AS (
  SELECT doc_id, bytes, arg_min({'depth': depth, 'prefix': prefix, 'bytes': shard_bytes, 'docs': shard_docs}, depth) AS s
  FROM nodes JOIN sums USING (depth, prefix) GROUP BY doc_id, bytes, key
)
SELECT doc_id, bytes, CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.prefix), CAST(s.depth AS INTEGER), '0') END AS shard,
  CAST(s.depth AS BIGINT) AS depth, CAST(s.bytes AS BIGINT) AS shard_bytes, CAST(s.docs AS BIGINT) AS shard_docs
FROM fits
"""

OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS words
  FROM documents
), grams AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 2], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1)) + 1)) AS i FROM w)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n
  HAVING 100 * count(*) >= 90 * (sa.n + sb.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM w LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""

OP7 = r"""
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, s, md5(array_to_string(words[s : s + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS s FROM w)
), firsts AS (
  SELECT h, min(doc_id) AS first_id FROM windows GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i
  FROM windows JOIN firsts USING (h) WHERE first_id < doc_id
), removed AS (
  SELECT doc_id, list(i) AS places, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(
    CASE WHEN n IS NULL THEN words ELSE list_filter(words, lambda x, i : NOT list_contains(places, i)) END, ' ')
  ) AS kept_sha256
FROM w LEFT JOIN removed USING (doc_id)
"""


def _fields(text: str) -> str:
    """The bytes that a leaf hashes."""
    columns = ("doc_id", "source", "lang", "n_chars", text)
    return " || ".join(
        f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in columns
    )


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels, runs of siblings, and tops of trees of ``tree, spot, hash`` with runs of three."""
    return f"""
{name}_nodes(level, tree, spot, hash) AS (
  SELECT 0, tree, spot, hash FROM {leaves}
  UNION ALL
  SELECT level + 1, tree, spot // 3, sha256(string_agg(hash, '' ORDER BY spot))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_nodes)
  WHERE n > 1 GROUP BY level, tree, spot // 3),
{name}_tops AS (SELECT tree, arg_max(hash, level) AS top, max(level) AS height FROM {name}_nodes GROUP BY tree),
{name}_runs AS (
  SELECT level, tree, spot // 3 AS run, list(hash ORDER BY spot) AS hashes
  FROM {name}_nodes GROUP BY level, tree, spot // 3),
{name}_ways(tree, spot, level, place, proof) AS (
  SELECT tree, spot, 0, spot, '' FROM {leaves}
  UNION ALL
  SELECT w.tree, w.spot, w.level + 1, place // 3,
    proof || array_to_string(hashes[:place % 3], '') || array_to_string(hashes[place % 3 + 2:], '')
  FROM {name}_ways w JOIN {name}_tops t USING (tree) JOIN {name}_runs r
    ON r.tree = w.tree AND r.level = w.level AND r.run = w.place // 3
  WHERE w.level < t.height)"""


# the lowest bit of the checksum of a doc_id's digits
_CRC_IS_EVEN = """list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(substr(CAST(doc_id AS VARCHAR), i, 1))::BIGINT)),
  lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
    lambda c, i: xor(c >> 1, (c & 1) * 3988292384::BIGINT))) & 1 = 1"""

OP13 = f"""
WITH RECURSIVE tampered AS (
  SELECT *, CASE WHEN {_CRC_IS_EVEN} THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
hashed AS (
  SELECT doc_id, coalesce(':' || source, '') AS tree, sha256({_fields("text")}) AS hash, sha256({_fields("changed")}) AS altered FROM tampered),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS spot FROM hashed),
{_tree("own", "leaves")},
groups AS (
  SELECT 0 AS tree, tree AS its, top AS hash, row_number() OVER (ORDER BY tree) - 1 AS spot FROM own_tops),
{_tree("all", "groups")},
folds(tree, spot, place, level, upper, group_at, hash) AS (
  SELECT l.tree, l.spot, l.spot, 0, false, g.spot, l.altered FROM leaves l JOIN groups g ON g.its = l.tree
  UNION ALL
  SELECT f.tree, f.spot,
    CASE WHEN upper OR f.level < t.height THEN place // 3 ELSE group_at END,
    CASE WHEN upper OR f.level < t.height THEN f.level + 1 ELSE 0 END,
    upper OR f.level >= t.height,
    group_at,
    CASE
      WHEN upper THEN sha256(array_to_string(a.hashes[:place % 3], '') || f.hash || array_to_string(a.hashes[place % 3 + 2:], ''))
      WHEN f.level < t.height THEN sha256(array_to_string(o.hashes[:place % 3], '') || f.hash || array_to_string(o.hashes[place % 3 + 2:], ''))
      ELSE f.hash END
  FROM folds f JOIN own_tops t USING (tree) CROSS JOIN all_tops top
  LEFT JOIN own_runs o ON NOT upper AND o.tree = f.tree AND o.level = f.level AND o.run = place // 3
  LEFT JOIN all_runs a ON upper AND a.level = f.level AND a.run = place // 3
  WHERE NOT upper OR f.level < top.height),
folded AS (
  SELECT f.tree, f.spot, f.hash AS folded_root FROM folds f CROSS JOIN all_tops top WHERE upper AND f.level = top.height)
SELECT l.doc_id, l.hash AS leaf, t.top AS subroot, top.top AS root, sha256(w.proof || v.proof) AS proof_sha256,
  d.folded_root, d.folded_root = top.top AS verified
FROM leaves l JOIN own_tops t USING (tree) CROSS JOIN all_tops top
JOIN groups g ON g.its = l.tree
JOIN own_ways w ON w.tree = l.tree AND w.spot = l.spot AND w.level = t.height
JOIN all_ways v ON v.spot = g.spot AND v.level = top.height
JOIN folded d ON d.tree = l.tree AND d.spot = l.spot
"""

ORACLES: dict[str, str] = {
    "op1_urls": OP1,
    "op2_embeddings": OP2,
    "op3_mixing": OP3,
    "op4_sharding": OP4,
    "op6_ngrams": OP6,
    "op7_substrings": OP7,
    "op13_manifest": OP13,
}
