"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactflow.llm import (
    bestfit,
    decontaminate,
    fingerprints,
    language,
    licenses,
    mixing,
    ngrams,
    pii,
    runs,
    simhash,
    structure,
    substrings,
    toolcalls,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the labelled documents, predict all."""
    docs = documents(spark, sf_dir)
    model = language.learn(docs.filter(~language.held_out()))
    judged = language.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", F.round("coverage", 6).alias("coverage"))


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_print("fp").alias("fingerprint"), "component_id")


@register
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _words_sql(text: str, symbols: bool = True) -> str:
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+" if symbols else "[^\\x20\\x09-\\x0D]+"
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '{pattern}')"


SQL["op3_decontaminate"] = f"""WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents),
i AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS passage FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS passage FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
o AS (SELECT doc_id, k, dw.n, item_id FROM dw JOIN iw USING (n, passage)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM o)) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM o GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""


@register
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.personal_data(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        *[pii.count_of(k, F.col("base")).alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(pii.listed(F.col("base")), F.lit("")), F.nullif(pii.listed(F.col("extra")), F.lit(""))).alias("spans"),
    )


@register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources by weight takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL["op8_mixing"] = """WITH d AS (SELECT doc_id, source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || left(md5('mix:' || doc_id), 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY 1),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, i) AS k FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM o),
f AS (SELECT level FROM l WHERE cap >= level * w ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * w) AS target FROM w),
q AS (SELECT *, CAST(floor(target) AS BIGINT) AS quota FROM t),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, CASE WHEN q.source_size > 0 THEN q.quota // q.source_size ELSE 0 END AS whole,
  CASE WHEN q.source_size > 0 THEN q.quota % q.source_size ELSE 0 END AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - gone)) AS BIGINT) AS taken FROM c"""


@register
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next document's."""
    return fingerprints.with_next(documents(spark, sf_dir))


@register
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base license phrases and all license labels of every document."""
    found = licenses.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])

    def labels(of):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        (F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0)) / 100).alias("score"),
    )


@register
def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words that start earlier."""
    found = substrings.drop_repeats(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op5_substrings"] = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM d WHERE len(w) >= 20),
s AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(w[k:k + 19], ' ') ORDER BY doc_id, k) AS nth FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM s WHERE nth > 1),
r AS (SELECT doc_id, list(i) AS gone, count(*) AS n_removed FROM c GROUP BY 1),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM
  (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE (doc_id, i) NOT IN (SELECT doc_id, i FROM c) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)"""


@register
def op1_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return ngrams.learn_and_score(docs, ~ngrams.held_out()).select(
        "doc_id", ngrams.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


TOOL_SCHEMAS = {
    "lookup": {"limit": ("integer", False), "text": ("string", True)},
    "search": {"limit": ("integer", True), "text": ("string", True)},
    "summarise": {"limit": ("number", True), "text": ("string", True)},
}
_TOOLS = list(TOOL_SCHEMAS)


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an agent's log: every assistant turn calls a tool with its text, every user turn is the result
    of the call in the turn before; every second call builds on the call two turns before."""
    quoted = "substring(to_json(array(t)), 2, length(to_json(array(t))) - 2)"
    return (
        spark.read.parquet(f"{sf_dir}/conversations.parquet")
        .select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("t"))
        .withColumns({"n": F.length("t"), "me": F.concat_ws("-", F.lit("c"), "conv_id", "turn"), "back": F.concat_ws("-", F.lit("c"), "conv_id", F.col("turn") - 2), "before": F.concat_ws("-", F.lit("c"), "conv_id", F.col("turn") - 1)})
        .withColumn("limit", F.expr("CASE WHEN n % 11 = 0 THEN '' WHEN n % 7 = 0 THEN ',\"limit\":\"many\"' ELSE concat(',\"limit\": ', n) END"))
        .withColumn("after", F.expr("CASE WHEN turn >= 3 AND n % 2 = 0 THEN concat(',\"after\":[\"', back, '\"]') ELSE '' END"))
        .withColumn("tool", F.expr(f"element_at(array('{_TOOLS[0]}', '{_TOOLS[1]}', '{_TOOLS[2]}'), cast(turn % 3 + 1 as int))"))
        .select(
            "conv_id",
            "turn",
            F.expr("CASE role WHEN 'user' THEN 'tool' ELSE role END").alias("role"),
            F.expr(
                "CASE role WHEN 'assistant' THEN concat('I call <tool_call>{\"name\": \"', tool, '\", \"arguments\": {\"text\": ', "
                + quoted
                + ", limit, '}, \"id\":\"', me, '\"', after, '}</tool_call> now') "
                "WHEN 'user' THEN concat('<tool_result>{\"id\":\"', before, '\",\"content\":{\"turn\":', turn, ', \"chars\":', n, '}}</tool_result>') ELSE t END"
            ).alias("text"),
        )
    )


@register
def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls of all conversations, linked, ordered, checked and written as canonical JSON."""
    linked = toolcalls.link(tool_messages(spark, sf_dir), TOOL_SCHEMAS)
    return linked.select(
        "conv_id", "position", "level", "id", "name", "call_turn", "result_turn", "n_results", "valid", "problems", F.sha2("json", 256).alias("json_sha256")
    )


SQL["op4_toolcalls"] = r"""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM conversations),
a AS (SELECT conv_id, turn, t, n, 'c-' || conv_id || '-' || turn AS id, ['lookup', 'search', 'summarise'][turn % 3 + 1] AS name,
  turn >= 3 AND n % 2 = 0 AS follows FROM c WHERE role = 'assistant'),
k AS (SELECT a.*, b.turn IS NOT NULL AS found FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn - 2 AND a.follows),
g AS (SELECT *, sum(CASE WHEN found THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM k),
l AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS BIGINT) AS level FROM g),
j AS (SELECT l.*, u.turn AS result_turn, u.n AS result_n FROM l LEFT JOIN c u ON u.conv_id = l.conv_id AND u.turn = l.turn + 1 AND u.role = 'user')
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn) AS position, level, id, name, turn AS call_turn, result_turn,
  CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS n_results,
  NOT (n % 11 = 0 AND name <> 'lookup') AND NOT (n % 11 <> 0 AND n % 7 = 0) AS valid,
  concat_ws('; ', CASE WHEN n % 11 = 0 AND name <> 'lookup' THEN 'missing limit' END,
    CASE WHEN n % 11 <> 0 AND n % 7 = 0 THEN CASE WHEN name = 'summarise' THEN 'not number: limit' ELSE 'not integer: limit' END END,
    CASE WHEN follows AND NOT found THEN 'unknown call' END, CASE WHEN result_turn IS NULL THEN 'no result' END) AS problems,
  sha256('{"arguments":{' || CASE WHEN n % 11 = 0 THEN '' WHEN n % 7 = 0 THEN '"limit":"many",' ELSE '"limit":' || n || ',' END || '"text":' || CAST(to_json(t) AS VARCHAR)
    || '},"id":"' || id || '","name":"' || name || '","result":'
    || CASE WHEN result_turn IS NULL THEN 'null' ELSE '{"chars":' || result_n || ',"turn":' || result_turn || '}' END || '}') AS json_sha256
FROM j"""


@register
def op11_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of 4096 tokens."""
    return bestfit.pack(documents(spark, sf_dir), with_ids=False).drop("ids")


@register
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with a periodic tail."""
    found = runs.find_runs(runs.with_tails(documents(spark, sf_dir)))
    best = runs.longest(F.col("runs"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(runs.listed(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({text}, '')]), lambda c, b: {step}), 4294967295)"


SQL["op12_runs"] = rf"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
a AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE [CASE WHEN i < a THEN w[i + 1] ELSE w[a + 1 + (i - a) % p] END for i in range(n)] END AS w FROM b),
i AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM i x JOIN i y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
s AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM
  (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM e) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.s <= s.s AND o.s + o.l >= s.s + s.l)),
g AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
  first({{'s': s, 'l': l, 'q': q}} ORDER BY l DESC, s, q) AS best FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM i ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)"""


@register
def op13_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, some of its turns damaged."""
    return structure.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _repair_sql() -> str:
    """The walk over the turns of each conversation. A state holds the least (cost, audit) of reaching it and the turns
    so written; costs have leading zeros, so that text order is the order of cost, then audit."""
    line = " || chr(10)"
    written = {"": "''", "u": f"'user:'{line}", "a": f"'assistant:'{line}", "ua": f"'user:'{line} || 'assistant:'{line}"}
    opened = {(0, 2): "u", (0, 3): "ua", (1, 2): "u", (1, 3): "ua", (2, 3): "a", (3, 2): "u"}

    def way(source: int, cost: str, letters: str, text: str) -> str:
        key = f"lpad(CAST(CAST(left(w.v{source}.k, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr(w.v{source}.k, 10) || '{letters}'"
        return f"CASE WHEN w.v{source} IS NOT NULL THEN {{'k': {key}, 't': w.v{source}.t || {text}}} END"

    offers: dict[int, list[str]] = {b: [] for b in range(4)}
    for a, to in structure.grammar.INSERTS.items():
        for here, n in to.items():
            before, i = written[opened.get((a, here), "")], "I" * n
            offers[here].append(way(a, str(5 * n + 2), i + "D", before))
            for (state, role), b in structure.grammar.MOVES.items():
                if state != here:
                    continue
                stay = f"5 * r.open + {5 * n}"
                kept = way(a, stay, i + "K", f"{before} || r.role || ':' || r.text{line}")
                offers[b].append(f"CASE WHEN NOT r.gone AND r.c = '{role}' THEN {kept} END")
                if role != "s":
                    name = {"u": "user", "a": "assistant"}[role]
                    moved = way(a, stay + " + 1", i + "R", f"{before} || '{name}:' || r.text{line}")
                    offers[b].append(f"CASE WHEN NOT r.gone THEN {moved} END")

    def least(of: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(of)}], lambda z: z IS NOT NULL))[1]"

    picks = ", ".join(f"{least(offers[b])} AS v{b}" for b in range(4))
    closing = [way(a, str(5 * n), "I" * n, written[t]) for a, n, t in ((0, 0, ""), (1, 2, "ua"), (2, 1, "a"), (3, 0, ""))]
    ends = least(closing)
    kind = _crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")
    ws = r"\x20\x09-\x0D"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {kind} % 20 AS kind FROM conversations),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM n),
f AS (SELECT *, NOT regexp_matches(text, '[^{ws}]') AS blank, regexp_extract(text, '([^{ws}])[{ws}]*$', 1) AS ending, left(role, 1) AS c,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM o),
r AS (SELECT *, blank OR nth > 1 AS gone, CASE WHEN ending IN ('.', '!', '?') THEN 0 ELSE 1 END AS open FROM f),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'k': '000000000', 't': ''}} AS v0, NULL::STRUCT(k VARCHAR, t VARCHAR) AS v1,
  NULL::STRUCT(k VARCHAR, t VARCHAR) AS v2, NULL::STRUCT(k VARCHAR, t VARCHAR) AS v3 FROM conversations
  UNION ALL SELECT w.conv_id, r.i, {picks} FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1),
z AS (SELECT conv_id, {ends} AS best FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM w) w WHERE back = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (NOT blank AND nth > 1) AS duplicate, count(*) FILTER (NOT gone AND open = 1) AS truncated,
  count(*) FILTER (i > 1 AND p || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY 1)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(left(best.k, 9) AS BIGINT) AS cost, substr(best.k, 10) AS audit, sha256(left(best.t, greatest(length(best.t) - 1, 0))) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id"""


SQL["op13_structure"] = _repair_sql()
