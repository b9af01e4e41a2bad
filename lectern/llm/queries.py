"""Registered queries of the operators: thin wrappers that derive digest columns from the operators' outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import chat, decontaminate, divergence, jaccard, licenses, mixing, ngrams, pii, quality, spelling, toxicity, urltree, vectors
from lectern.llm.common import read_table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chat(rows.unionByName(extra)))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))
    return scored.withColumn("evidence", F.to_json("evidence"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near, near_sha256: items of which a window stands with one or two of its ten words changed, and none unchanged."""
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.transform(c, lambda i: i.cast("string"))), ",").cast("binary"), 256)
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_words", "n_hit", size("items").alias("n_items"), digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), size("near_items").alias("n_near"), digest("near_items").alias("near_sha256"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email to n_phone count base spans, n_added those that the tagger adds (its kind `secret` comes last), n_spans all."""
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    of = lambda spans, kind: F.filter(spans, lambda s: s["kind"] == kind)
    listed = F.concat(*(F.array_sort(of(F.concat("base", "added"), k)) for k in pii.KINDS))
    counts = [F.size(of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    added, every = F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(listed).alias("spans"), added, every)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    names = lambda c: F.transform(c, lambda x: x["label"])
    starts = F.transform("base", lambda x: x["start"])
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), join(names("base")).alias("base_labels"), join(F.concat(names("base"), names("own"))).alias("labels"), "score", "best")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(read_table(spark, sf_dir, "documents"))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(read_table(spark, sf_dir, "pages")).withColumn("score", F.round("score", 9))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(read_table(spark, sf_dir, "documents"))


# The columns of op5 and op7 that SQL can express, held against it.


def lm_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def pii_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


QUERIES = {f.__name__: f for f in (lm_base_columns, pii_base_columns, op1_embedding_near_dedup, op2_chat_format, op3_source_mix, op4_toxicity, op5_lm_score, op6_decontaminate, op7_pii, op8_license_scan, op9_quality, op10_jaccard_join, op11_divergence_audit, op12_url_filter, op13_spelling_variants)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_SPACED = r"[^\x20\x09-\x0D]+"


def _seeded(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


#: crc32 of an id as text, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT)"""

_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(x AS INT), 999) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", """length(n) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN substr(reverse(n), i, 1)::INT WHEN substr(reverse(n), i, 1)::INT > 4 THEN 2 * substr(reverse(n), i, 1)::INT - 9 ELSE 2 * substr(reverse(n), i, 1)::INT END)) % 10 = 0"""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(n) BETWEEN 9 AND 15"),
}


def _pii_sql() -> str:
    """Matches are marked, texts are cut at the marks, and the pieces' lengths give the places."""
    cut = lambda k, kind, pattern: f"SELECT doc_id, {k} AS k, '{kind}' AS kind, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM documents"
    every = " UNION ALL ".join(cut(k, kind, pattern) for k, (kind, (pattern, _)) in enumerate(_PII.items()))
    good = " OR ".join(f"(kind = '{kind}' AND {rule})" for kind, (_, rule) in _PII.items())
    return f"""
WITH cut AS ({every}),
found AS (
  SELECT doc_id, k, kind, split_part(parts[i], chr(2), 1) AS m, list_sum(list_transform(parts[1:i - 1], lambda p: length(p))) - (i - 2) AS a
  FROM cut, unnest(range(2, len(parts) + 1)) AS t(i)),
spans AS (SELECT doc_id, k, kind, a::BIGINT AS a, (a + length(m))::BIGINT AS z FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM found) WHERE {good}),
rows AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in _PII)}, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY k, a) AS base FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind in _PII)}, sha256(coalesce(base, '')) AS base_sha256 FROM documents d LEFT JOIN rows USING (doc_id)"""


def _license_sql(gap: int = 3, coverage: float = 0.8, longer: float = 1.25) -> str:
    table = ",\n".join(f"('{name}', '{label}', {str(is_base).lower()}, {words})" for name, label, is_base, words in licenses.templates())
    return f"""
WITH t(template, label, is_base, words) AS (VALUES {table}),
g AS (
  SELECT template, label, is_base, len(words) AS size, least(3, len(words)) AS k, p - 1 AS t_pos, array_to_string(words[p:p + least(3, len(words)) - 1], ' ') AS gram
  FROM t, unnest(range(1, len(words) - least(3, len(words)) + 2)) AS u(p)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
dg AS (SELECT doc_id, k, p - 1 AS pos, array_to_string(w[p:p + k - 1], ' ') AS gram FROM d, (VALUES (2), (3)) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(p)),
votes AS (SELECT doc_id, template, label, is_base, size, g.k, pos, t_pos, pos - t_pos AS diagonal FROM dg JOIN g ON g.k = dg.k AND g.gram = dg.gram),
lines AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM (SELECT DISTINCT doc_id, template, is_base, diagonal FROM votes)),
groups AS (SELECT doc_id, template, diagonal, sum(CASE WHEN is_base OR before IS NULL OR diagonal - before > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS grp FROM lines),
hits AS (SELECT v.*, grp FROM votes v JOIN groups USING (doc_id, template, diagonal)),
merged AS (
  SELECT doc_id, template, label, is_base, size, grp, min(pos) AS a, max(pos + k) AS z,
    len(list_distinct(flatten(list(range(t_pos, t_pos + k))))) / size AS coverage FROM hits GROUP BY doc_id, template, label, is_base, size, grp),
named AS (SELECT *, NOT is_base AND coverage >= CASE WHEN size < {licenses.SHORT} THEN 1.0 ELSE {coverage} END AND z - a <= {longer} * size AS own FROM merged),
rows AS (
  SELECT doc_id, count(*) FILTER (is_base) AS n_base, min(a) FILTER (is_base) AS first_word, max(a) FILTER (is_base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base OR own) AS labels, max(coverage) FILTER (own) AS score, max(coverage) AS best
  FROM named GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score, coalesce(best, 0)::DOUBLE AS best FROM d LEFT JOIN rows USING (doc_id)"""


_COMPONENTS = """
reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.b AS other FROM reach r JOIN links l ON l.a = r.other)"""

_DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(n, 0)::HUGEINT AS n, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c, 0) + 2) // (n + 2 * v) AS p FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(c) + 2) // (any_value(n) + 2 * any_value(v)) AS q FROM c JOIN (SELECT lang, sum(n) AS n, any_value(v) AS v FROM g GROUP BY lang) USING (lang) GROUP BY lang, term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 10"""


def _url_sql(depth: int = 8) -> str:
    """The tree level by level: t0 holds the paths at their hosts, each level's steps follow."""
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}')"
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in sorted(urltree.RULES, key=lambda r: (-len(r.name), r.name))) + " END"
    alike = lambda c: f"({c} * lag(n) OVER o - lag({c}) OVER o * n)::DOUBLE ** 2 * (n + lag(n) OVER o) <= {urltree.Z2} * n * lag(n) OVER o * ({c} + lag({c}) OVER o) * (n + lag(n) OVER o - {c} - lag({c}) OVER o)"
    level = lambda k: f"""
v{k} AS (SELECT host, node, score, rest[1] AS seg, sum(n) AS n, sum(b) AS b, sum(a) AS a, sum(CASE WHEN len(rest) = 1 THEN n ELSE 0 END) AS e FROM t{k} WHERE len(rest) > 0 GROUP BY ALL),
w{k} AS (SELECT *, CASE WHEN n >= 3 AND n >= 0.05::DOUBLE * sum(n) OVER (PARTITION BY host, node) THEN seg ELSE '*' END AS branch FROM v{k}),
b{k} AS (SELECT host, node, score, branch, sum(n)::DOUBLE AS n, sum(b)::DOUBLE AS b, sum(a)::DOUBLE AS a, sum(e)::DOUBLE AS e FROM w{k} GROUP BY host, node, score, branch),
s{k} AS (SELECT *, CASE WHEN branch <> '*' AND {alike("b")} AND {alike("a")} AND {alike("e")} THEN 0 ELSE 1 END AS new FROM b{k} WINDOW o AS (PARTITION BY host, node ORDER BY branch = '*', b / n DESC, a / n DESC, e / n DESC, branch)),
g{k} AS (SELECT *, sum(new) OVER (PARTITION BY host, node ORDER BY branch = '*', b / n DESC, a / n DESC, e / n DESC, branch ROWS UNBOUNDED PRECEDING) AS g FROM s{k}),
m{k} AS (SELECT host, node, g, (sum(b) + 4 * any_value(score)) / (sum(n) + 4) AS below, CASE WHEN count(*) > 1 THEN '(' || string_agg(branch, '|' ORDER BY branch) || ')' ELSE any_value(branch) END AS name FROM g{k} GROUP BY host, node, g),
t{k + 1} AS (
  SELECT t.host, shape, t.rest[2:] AS rest, t.node || '/' || name AS node, below AS score, t.n, t.b, t.a
  FROM (SELECT *, rest[1] AS seg FROM t{k} WHERE len(rest) > 0) t JOIN w{k} USING (host, node, seg) JOIN g{k} gk ON gk.host = t.host AND gk.node = t.node AND gk.branch = w{k}.branch JOIN m{k} mk ON mk.host = t.host AND mk.node = t.node AND mk.g = gk.g)"""  # noqa: E731
    return f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
r AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urltree.UPPER}', '{urltree.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
q AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS label, list_filter(string_split(path, '/'), lambda s: s <> '') AS every FROM r),
p AS (SELECT *, list_transform(every[1:{depth}], lambda s: CASE WHEN length(s) > 64 THEN '{{long}}' WHEN regexp_matches(s, '^[0-9a-fA-F-]{{16,}}$') THEN '{{x}}' ELSE regexp_replace(s, '[0-9]+', '{{n}}', 'g') END) || CASE WHEN len(every) > {depth} THEN ['**'] ELSE [] END AS segs FROM q),
h AS (SELECT host, segs, count(*) AS n, count(*) FILTER (label = 'block') AS b, count(*) FILTER (label = 'allow') AS a FROM p GROUP BY host, segs),
t0 AS (SELECT host, array_to_string(segs, '/') AS shape, segs AS rest, '' AS node, (sum(b) OVER (PARTITION BY host) + 4 * (SELECT sum(b) / sum(n) FROM h)) / (sum(n) OVER (PARTITION BY host) + 4) AS score, n, b, a FROM h),
{",".join(level(k) for k in range(depth + 1))},
done AS ({" UNION ALL ".join(f"SELECT host, shape, node, score FROM t{k} WHERE len(rest) = 0" for k in range(depth + 2))})
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN score >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, node AS template, round(score, 9) AS score FROM (SELECT *, array_to_string(segs, '/') AS shape FROM p) LEFT JOIN done USING (host, shape)"""


#: Neighbours meet by patterns with one letter left out, not by masks; crc32 byte by byte from its table.
_SPELLING = rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))) AS crc),
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n FROM r GROUP BY doc_id, w),
b AS (SELECT *, list_concat(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':', ''), lambda c: ascii(c)::BIGINT),
    flatten(list_transform(string_split(w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))) AS bytes FROM u),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda s, x: xor(s >> 8, crc[(xor(s, x) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, bits),
g AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
known AS (SELECT w, sum(n)::BIGINT AS n FROM g WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
gaps AS (SELECT DISTINCT w, i, substr(w, 1, i - 1) AS l, substr(w, i + 1) AS z FROM known, unnest(range(1, length(w) + 1)) AS t(i)),
near AS (
  SELECT x.w AS a, y.w AS b FROM gaps x JOIN gaps y ON x.i = y.i AND x.l = y.l AND x.z = y.z AND x.w <> y.w
  UNION SELECT k.w, gaps.w FROM gaps JOIN known k ON gaps.l || gaps.z = k.w UNION SELECT gaps.w, k.w FROM gaps JOIN known k ON gaps.l || gaps.z = k.w),
best AS (SELECT a AS w, b, k.n AS b_n, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN known k ON k.w = near.b QUALIFY row_number() OVER (PARTITION BY a ORDER BY k.n DESC, b) = 1),
f AS (SELECT k.w, CASE WHEN b_n >= 2 * k.n THEN b END AS form, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 2 * k.n THEN b_n END AS form_n FROM known k LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS last, form AS ahead FROM f UNION ALL SELECT walk.w, f.w, f.form FROM walk JOIN f ON f.w = walk.ahead)
SELECT f.w AS word, form, last AS root, n, n_near, form_n FROM f JOIN walk ON walk.w = f.w AND walk.ahead IS NULL"""


ORACLES = {
    "op12_url_filter": _url_sql(),
    "op13_spelling_variants": _SPELLING,
    "op11_divergence_audit": _DIVERGENCE,
    "op1_embedding_near_dedup": f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (
  SELECT id, label, e, sqrt(list_inner_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.id AS a, y.id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.id <> y.id
  WHERE list_inner_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS},
class AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(DISTINCT b) AS n FROM links GROUP BY a)
SELECT v.id AS vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(c.component_id, v.id) AS component_id,
  v.id = coalesce(c.component_id, v.id) AS kept
FROM v LEFT JOIN class c USING (id) LEFT JOIN degree d USING (id)""",
    "op2_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '<\\*(\||/?s>)')) + len(regexp_extract_all(text, '\[\\*/?INST\]')) AS escapes FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(text) + escapes + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id""",
    "op3_source_mix": f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACED}')), 0)::BIGINT AS size FROM documents),
h AS (SELECT *, {_seeded("'11:' || coalesce(doc_id::VARCHAR, '') || ':' || size")} AS h FROM d),
r AS (SELECT h.*, h.h % n.shards AS shard, CASE WHEN h.source IS NULL THEN '' ELSE '=' || h.source END AS key FROM h JOIN (SELECT source, ceil(count(*) / 16384)::BIGINT AS shards FROM h GROUP BY source) n ON h.source IS NOT DISTINCT FROM n.source),
s AS (SELECT key, source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w FROM r GROUP BY key, source),
-- sources that stop come first, by the words for a unit of weight at which they stop
o AS (
  SELECT *, row_number() OVER up AS i, (SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(3 * source_size) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    (SELECT sum(w) FROM s) - coalesce(sum(w) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM s WINDOW up AS (ORDER BY source_size / w, key)),
f AS (SELECT rest AS f_rest, open AS f_open FROM o WHERE rest * w / open <= 3 * source_size ORDER BY i LIMIT 1),
goals AS (SELECT key, source_size, CASE WHEN f_open IS NULL OR f_rest * w / f_open > 3 * source_size THEN 3.0 * source_size ELSE f_rest * w / f_open END::DOUBLE AS target FROM s LEFT JOIN f ON true),
b AS (SELECT greatest(1, least(4096, sum(size) // 65536)) AS block FROM d),
-- all quotients are ranked, those of the targets among all sources, then those of the words within a source
t AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM goals),
n AS (SELECT ((sum(goal) + any_value(block) // 2) // any_value(block))::BIGINT AS seats FROM t, b),
tq AS (SELECT key, goal / (2 * k + 1)::DOUBLE AS q, k FROM t, n, unnest(range(0, CASE WHEN goal > 0 THEN seats ELSE 0 END::BIGINT)) AS u(k)),
ts AS (SELECT key, count(*) AS seats FROM (SELECT key FROM tq ORDER BY q DESC, key, k LIMIT (SELECT seats FROM n)) GROUP BY key),
sh AS (SELECT key, shard, sum(size)::BIGINT AS words FROM r GROUP BY key, shard),
sq AS (SELECT key, shard, row_number() OVER (PARTITION BY key ORDER BY words / (2 * k + 1)::DOUBLE DESC, shard, k) AS n, seats FROM sh JOIN ts USING (key), unnest(range(0, CASE WHEN words > 0 THEN seats ELSE 0 END::BIGINT)) AS u(k)),
ss AS (SELECT key, shard, count(*) AS quota FROM sq WHERE n <= seats GROUP BY key, shard),
g0 AS (SELECT sh.key, sh.shard, words, source_size, target, goal, block, least(coalesce(quota, 0) * block, 3 * words)::BIGINT AS given FROM sh JOIN t USING (key) LEFT JOIN ss ON ss.key = sh.key AND ss.shard = sh.shard, b),
g1 AS (SELECT *, goal - sum(given) OVER (PARTITION BY key) AS gap FROM g0),
g2 AS (SELECT *, CASE WHEN gap > 0 THEN 3 * words - given ELSE given END AS room FROM g1),
g3 AS (SELECT *, sum(room) OVER (PARTITION BY key ORDER BY words DESC, shard ROWS UNBOUNDED PRECEDING) - room AS before FROM g2),
p AS (SELECT * REPLACE ((given + CASE WHEN gap > 0 THEN 1 ELSE -1 END * least(room, greatest(0, abs(gap) - before)))::BIGINT AS given) FROM g3),
plan AS (
  SELECT key, shard, words, source_size, target, CASE WHEN words > 0 THEN given // words ELSE 0 END AS passes, given - CASE WHEN words > 0 THEN given // words ELSE 0 END * words AS rest,
    ({_seeded("'11:' || shard || ':' || key")} % greatest(ceil(words / block)::BIGINT, 1)) * block AS a FROM p),
line AS (SELECT *, sum(size) OVER (PARTITION BY key, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS z FROM r)
SELECT doc_id, source, size, source_size, target, (passes * size + greatest(0, least(z, a + rest, words) - greatest(z - size, a)) + greatest(0, least(z, a + rest - words) - greatest(z - size, 0)))::BIGINT AS taken
FROM line JOIN plan USING (key, shard)""",
    "lm_base_columns": f"""
WITH d AS (SELECT doc_id, {_CRC} % 5 AS fold, list_append(regexp_extract_all({_LOWER}, '{_SPACED}'), chr(10)) AS w FROM documents),
t AS (SELECT unnest(w) AS token FROM d WHERE fold <> 1), c AS (SELECT token, count(*) AS c FROM t GROUP BY token), n AS (SELECT count(*) AS n, count(DISTINCT token) AS v FROM t),
k AS (SELECT doc_id, unnest(w) AS token FROM d),
s AS (SELECT doc_id, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))) AS base_score FROM k LEFT JOIN c USING (token), n GROUP BY doc_id)
SELECT doc_id, fold = 1 AS held_out, n_tokens::BIGINT AS n_tokens, n_known::BIGINT AS n_known, n::BIGINT AS train_tokens, round(base_score, 4) AS base_score FROM d JOIN s USING (doc_id), n""",
    "pii_base_columns": _pii_sql(),
    "op8_license_scan": _license_sql(),
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
i AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0), unnest(range(1, len(w) - k + 2)) AS t(p)),
sizes AS (SELECT DISTINCT k FROM i),
h AS (
  SELECT doc_id, item_id, k, p
  FROM (SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM d, sizes, unnest(range(1, len(w) - k + 2)) AS t(p)) JOIN i USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
-- of ten words of which eight stand in their places, three in a row do
wins AS (SELECT DISTINCT w[p:p + 9] AS g FROM (SELECT * FROM b WHERE len(w) >= 10), unnest(range(1, len(w) - 8)) AS t(p)),
subs AS (SELECT g, j, array_to_string(g[j:j + 2], ' ') AS part FROM wins, unnest(range(1, 9)) AS t(j)),
meet AS (
  SELECT DISTINCT doc_id, p - j + 1 AS p, g FROM (SELECT doc_id, p, len(w) AS n, array_to_string(w[p:p + 2], ' ') AS part FROM d, unnest(range(1, len(w) - 1)) AS t(p)) JOIN subs USING (part) WHERE p - j + 1 >= 1 AND p - j + 10 <= n),
close AS (
  SELECT DISTINCT doc_id, g FROM meet JOIN d USING (doc_id) WHERE list_sum(list_transform(range(1, 11), lambda i: (w[p + i - 1] = g[i])::INT)) BETWEEN 8 AND 9),
near AS (
  SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM close JOIN (SELECT DISTINCT item_id, w[p:p + 9] AS g FROM (SELECT * FROM b WHERE len(w) >= 10), unnest(range(1, len(w) - 8)) AS t(p)) USING (g)
    EXCEPT SELECT DISTINCT doc_id, item_id::VARCHAR FROM h) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near.items, '')) AS near_sha256, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(named.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS (
  SELECT doc_id AS id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM d),
t AS (SELECT id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT g FROM t GROUP BY g HAVING count(*) > 1),
u AS (SELECT t.* FROM t SEMI JOIN shared USING (g)),
links AS (
  SELECT x.id AS a, y.id AS b FROM u x JOIN u y ON x.g = y.g AND x.id <> y.id
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
nodes AS (SELECT DISTINCT a AS id FROM links),{_COMPONENTS},
class AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT s.id AS doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(c.component_id, s.id) AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM sets s LEFT JOIN class c USING (id) LEFT JOIN degree k USING (id)""",
}
