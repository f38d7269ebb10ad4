"""Registered queries of the operators in this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.llm import (byte_bpe, chat_format, decontaminate, embedding_dedup, filter_audit, jaccard_join, line_dedup, lm_scoring, pii, secret_scan,
                          substring_dedup, toxicity, vector_codes)
from wearcast.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            ship_package(spark)
            return f(spark, sf_dir)
        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lower-cases A-Z only, as the contracts ask, whatever else lower() would change.
_LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"regexp_extract_all(" + _LOWER_AZ.format("coalesce({}, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register("op3_decontamination", f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS.format('text')} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS.format('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n,
        array_to_string(w[k + 1:k + least(len(w), 10)], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, n, k, array_to_string(w[k + 1:k + n], ' ') AS phrase
      FROM (SELECT doc_id, n, w, unnest(range(len(w) - n + 1)) AS k FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, k, o.n AS n, item FROM o JOIN p ON o.phrase = p.phrase AND o.n = p.n),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""")
def q_decontamination(spark, sf_dir):
    """Every document against every benchmark window of 10 words."""
    return decontaminate.report(decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, unnamed=True))


def _vocabulary() -> tuple[str, str]:
    """(rank file, splitting pattern) of the public byte-level vocabulary; the operator takes any other."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@register("op5_byte_bpe")
def q_byte_bpe(spark, sf_dir):
    """Every whole text encoded, then decoded."""
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), *_vocabulary())
    return byte_bpe.digests(byte_bpe.decode(ids, *_vocabulary()))


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@register("op10_toxicity")
def q_toxicity(spark, sf_dir):
    """Every document scored; labels of the held-out quarter (crc32 mod 4 = 2) are not seen."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(remainder(4) != 2))
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"


@register("op2_substring_dedup", f"""
WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
win AS (SELECT doc_id, k, md5(array_to_string(w[k + 1:k + 35], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS k FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, k FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, list(pos) AS gone FROM (SELECT DISTINCT doc_id, unnest(range(k + 1, k + 36)) AS pos FROM rep) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""")
def q_substring_dedup(spark, sf_dir):
    """Every document without the words of its recurring 35-word windows."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op8_jaccard_join", f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER_AZ.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n p ON o.a = p.doc_id JOIN n q ON o.b = q.doc_id WHERE 100 * shared >= 90 * (p.n + q.n - shared)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN c ON d.doc_id = c.a""")
def q_jaccard_join(spark, sf_dir):
    """Every document's component under a Jaccard similarity of 0.9 on 3-word shingles."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


@register("op6_line_dedup")
def q_line_dedup(spark, sf_dir):
    """Every document without the lines whose like stands elsewhere before."""
    return line_dedup.report(table(spark, sf_dir, "documents"))


@register("op4_embedding_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""")
def q_embedding_dedup(spark, sf_dir):
    """Every vector's links and component under a cosine of 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


@register("op7_pii")
def q_pii(spark, sf_dir):
    """Spans of personal data in every document."""
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.find(docs, pii.fit(docs)))


@register("op1_lm_scoring")
def q_lm_scoring(spark, sf_dir):
    """Every document scored; a seventh of them (crc32 mod 7 = 2) is not learned from."""
    out = lm_scoring.score(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: The one tool of the derived calls below.
REPLY = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {
    "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "array", "items": {"type": "string"}}}}}


def turns_as_calls(chats: DataFrame) -> DataFrame:
    """The table holds no tool calls, so each question becomes one: a user's turn is a call, the assistant's next turn its
    result. The length of its text says what a call waits for (the question two turns before, the one two turns later, or
    nothing), whether it names a tool that nobody knows and whether its turn is text in place of a number. Other turns stay
    plain messages."""
    def call_at(turn):
        return F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))

    turn, own = F.col("turn"), F.coalesce("text", F.lit(""))
    kind = F.length(own) % 8
    after = F.when(kind < 3, F.array(call_at(turn - 2))).when(kind < 5, F.array(call_at(turn + 2))).otherwise(F.array().cast("array<string>"))
    tool = F.when(kind == 7, "search").otherwise("reply")
    args = F.when(kind == 6, F.to_json(F.struct(own.alias("prompt"), turn.cast("string").alias("turn"), after.alias("after")))) \
        .otherwise(F.to_json(F.struct(own.alias("prompt"), "turn", after.alias("after"))))
    call = F.to_json(F.struct(F.array(F.struct(call_at(turn).alias("id"), F.lit("function").alias("type"), F.struct(tool.alias("name"), args.alias("arguments")).alias("function"))).alias("tool_calls")))
    result = F.to_json(F.struct(call_at(turn - 1).alias("tool_call_id"), own.alias("content")))
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    return chats.select("conv_id", "turn", F.when(asks, "assistant").when(answers, "tool").otherwise(F.col("role")).alias("role"),
                        F.when(asks, call).when(answers, result).otherwise(F.col("text")).alias("text"))


@register("op9_chat_formatting")
def q_chat_formatting(spark, sf_dir):
    """Every turn as a linked, ordered and validated event."""
    return chat_format.format_chats(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)


@register("op11_secret_scan")
def q_secret_scan(spark, sf_dir):
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.report(secret_scan.find(docs, secret_scan.fit(docs)))


_ORDERS = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"


@register("op12_filter_audit", rf"""
WITH l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ 	-
]+') AS w FROM t),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t),
         regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)] AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic, len(list_filter(fails, lambda x: x)) AS n_fails FROM f GROUP BY part, fails),
o AS (SELECT a || b || c || d || e AS filter_order FROM {_ORDERS} u(a), {_ORDERS} v(b), {_ORDERS} w(c), {_ORDERS} x(d), {_ORDERS} y(e)
      WHERE a NOT IN (b, c, d, e) AND b NOT IN (c, d, e) AND c NOT IN (d, e) AND d <> e),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, instr('ABCDE', substr(filter_order, CAST(step AS INTEGER), 1)) AS own FROM o, range(1, 6) r(step)),
x AS (SELECT part, filter_order, step, own, n, good, toxic, n_fails, fails[own] AS failing,
        len(list_filter(range(1, step), lambda p: fails[instr('ABCDE', substr(filter_order, CAST(p AS INTEGER), 1))])) > 0 AS gone
      FROM c, s),
a AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END) AS kept,
        sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND failing THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END) AS good_lost,
        sum(CASE WHEN NOT gone AND failing THEN toxic ELSE 0 END) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM a""")
def q_filter_audit(spark, sf_dir):
    """Every step of every order of the five filters, by language."""
    return filter_audit.audit(filter_audit.contingency(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def _codes_sql() -> str:
    """Unrolled rounds: assignment by squared distances (whole numbers, exact in doubles), floored means, unused entries kept."""
    steps = ["""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
p AS MATERIALIZED (SELECT r, vec_id, label, part, v[CAST(part * (len(v) // 4) + 1 AS BIGINT):CAST((part + 1) * (len(v) // 4) AS BIGINT)] AS x FROM k, range(4) q(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= 256)"""]
    for i in range(5):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p.part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': entry}}) AS best
  FROM p JOIN c{i} USING (part) GROUP BY r, p.part)""")
        if i < 4:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (
  SELECT part, entry, list(v ORDER BY pos) AS c FROM (SELECT part, entry, pos, floor(sum(v) / count(*)) AS v FROM (
    SELECT p.part, best.e AS entry, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM p JOIN a{i} a ON p.r = a.r AND p.part = a.part) GROUP BY part, entry, pos) GROUP BY part, entry) m
  ON o.part = m.part AND o.entry = m.entry)""")
    return "WITH " + ",\n".join(steps) + """,
z AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS s FROM c4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM k JOIN z USING (r), h"""


@register("op13_vector_codes", _codes_sql())
def q_vector_codes(spark, sf_dir):
    """Every vector's code in four parts of 256 entries."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))
