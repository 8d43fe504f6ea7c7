"""Queries of what texts signal: types, query features, sentiment, sensitive spans, captured noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.fixtures import Tables
from engram.functions import signals
from engram.plans.registry import register


def q(x: str) -> str:
    """A SQL literal."""
    return "'" + x.replace("'", "''") + "'"


def _like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


_TYPES = f"CASE WHEN {_like('low', signals.any_word(signals.TODO))} AND NOT {_like('low', signals.any_word(signals.NOT_TODO))} THEN 'todo' " + " ".join(f"WHEN {_like('low', signals.any_word(w))} THEN '{n}'" for n, w in signals.TYPE_WORDS) + " ELSE 'fact' END"
#: All texts: documents, conversation turns and test items.
_TEXTS = """texts AS (SELECT 'd:' || doc_id AS id, text FROM documents UNION ALL SELECT 't:' || conv_id || ':' || turn, text FROM conversations UNION ALL SELECT 'i:' || item_id, text FROM benchmark)"""


def texts(t: Tables) -> DataFrame:
    d, c, b = t.read("documents"), t.read("conversations"), t.read("benchmark")
    out = d.select(t.key("d", "doc_id").alias("id"), "text").union(c.select(F.concat(F.lit("t:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")), "text"))
    return out.union(b.select(t.key("i", "item_id"), "text"))


#: What is said of an order, before and after its number: times, causes and comparisons, and things worth keeping.
SAYINGS = (
    ("We paid order ", " the day before yesterday."), ("Order ", " was packed yesterday."), ("Check order ", " this morning, please."), ("The truck with order ", " arrives tonight."), ("Order ", " is due tomorrow."), ("Count order ", " again this week."), ("Order ", " was late last week."), ("Next week order ", " goes out."), ("Order ", " came up recently."), ("Order ", " was moved in the last few days."),
    ("Order ", " was placed 12 days ago."), ("Order ", " was sealed 3 weeks ago."), ("Order ", " leaves in 5 days."), ("Order ", " returns in 2 weeks."), ("Order ", " came yesterday and leaves tomorrow, 3 days ago it was here."),
    ("The delay of order ", " happened because the bridge was closed."), ("Order ", " was delayed and that was caused by heavy rain. It waits."), ("Order ", " came back as a result of a wrong label."), ("The label of order ", " was torn therefore it was printed again."), ("A wet floor under order ", " leads to mould in the boxes; move it."),
    ("The size of order ", " is similar to the order before it."), ("The price of order ", " unlike the price of others fell."), ("Shipping order ", " by rail is better than shipping it by road."), ("Weigh order ", " before loading the second truck."), ("Close order ", " after the customer has signed."),
    ("We decided to ship order ", " by rail."), ("The decision is to hold order ", " for a week."), ("We moved to a new carrier for order ", " and others."), ("Error: order ", " has no address."), ("The issue was the address of order ", "; it was empty!"), ("Problem: order ", " weighs more than it should."), ("Fixed by printing the label of order ", " again."),
    ("TODO: call the customer of order ", " about the door code."), ("Remember to weigh order ", " twice."), ("The solution is to split order ", " into two boxes."), ("We learned that order ", " fits through the small door."), ("Turns out order ", " had been paid twice."), ("The root cause was a swapped label on order ", " and its neighbour."), ("Lesson learned: order ", " needs a dry place."),
    ("I prefer to send order ", " by train."), ("We avoid sending order ", " at night."), ("Always use thick paper for order ", " and the like."),
)
#: All texts and what is said of each order.
_SAID_TOO = _TEXTS.removesuffix(")") + f" UNION ALL SELECT 'o:' || o_orderkey, [{', '.join(q(a) for a, _ in SAYINGS)}][o_orderkey % {len(SAYINGS)} + 1] || o_orderkey || [{', '.join(q(b) for _, b in SAYINGS)}][o_orderkey % {len(SAYINGS)} + 1] FROM orders)"


def said_too(t: Tables) -> DataFrame:
    nth = (F.col("o_orderkey") % len(SAYINGS)).cast("int")
    part = lambda i: F.get(F.array(*[F.lit(x[i]) for x in SAYINGS]), nth)
    said = t.read("orders").select(t.key("o", "o_orderkey"), F.concat(part(0), F.col("o_orderkey").cast("string"), part(1)))
    return texts(t).union(said)


@register("sc20_memory_type", f"WITH {_TEXTS} SELECT id, {_TYPES} AS memory_type FROM (SELECT id, lower(coalesce(text, '')) AS low FROM texts)")
def sc20(spark: SparkSession, sf: str) -> DataFrame:
    return texts(Tables(spark, sf)).select("id", signals.memory_type(F.coalesce("text", F.lit(""))).alias("memory_type"))


_SCORES = [f"round({w}::DOUBLE * (" + " + ".join(f"CAST({_like('low', p)} AS INTEGER)" for p in ps) + "), 4)" for _, w, ps in signals.INTENTS]
_ROLE = lambda ps: " + ".join(f"CAST({_like('low', signals.any_word([p]))} AS INTEGER)" for p in ps)
_FEATURES = f"""WITH {_TEXTS},
a AS (SELECT id, low, string_split(trim(regexp_replace(low, '\\s+', ' ', 'g')), ' ') AS w, {", ".join(f"{s} AS s{i}" for i, s in enumerate(_SCORES))}, {_ROLE(signals.ASSISTANT)} AS theirs, {_ROLE(signals.USER)} AS mine
  FROM (SELECT id, lower(coalesce(text, '')) AS low FROM texts)),
b AS (SELECT *, greatest({", ".join(f"s{i}" for i in range(len(signals.INTENTS)))}) AS best FROM a),
c AS (SELECT *, CASE WHEN best = 0 THEN 'recall' {" ".join(f"WHEN s{i} = best THEN '{n}'" for i, (n, _, _) in enumerate(signals.INTENTS))} END AS intent FROM b)
SELECT id, intent, CASE WHEN intent IN ('confirm', 'compare') THEN intent WHEN {_like('low', '|'.join(signals.SUMMARY))} THEN 'summarize' WHEN {_like('low', '|'.join(signals.ANALYSIS))} THEN 'analyze' ELSE 'recall' END AS perspective,
  CASE WHEN intent IN ('ask_why', 'ask_feeling') THEN 'deep' WHEN intent = 'ask_pattern' THEN 'habit' WHEN intent IN ('ask_how', 'compare') OR list_has_any(w, [{", ".join(map(q, signals.AROUND))}]) THEN 'context' ELSE 'instant' END AS depth,
  CASE WHEN (length(low) >= 20 AND len(regexp_extract_all(low, {q(f'[{signals.VIETNAMESE_ALL}]')})) > 0.05 * length(low)) OR {_like('low', f'[{signals.VIETNAMESE}]')} OR list_has_any(w, [{", ".join(map(q, signals.VIETNAMESE_WORDS))}]) THEN 'vi' ELSE 'en' END AS lang,
  CASE WHEN length(low) < 5 THEN NULL WHEN theirs > 0 AND theirs >= mine THEN 'assistant' WHEN mine > theirs THEN 'user' END AS role FROM c"""


@register("sc21_query_features", _FEATURES)
def sc21(spark: SparkSession, sf: str) -> DataFrame:
    return texts(Tables(spark, sf)).select("id", signals.query_features(F.col("text")).alias("f")).select("id", "f.*")


_IN = lambda kind, x: f"list_contains([{', '.join(map(q, signals.LEXICON[kind]))}], {x})"
_NEGATED = f"(coalesce({_IN('negator', 'w[i - 1]')}, false) OR coalesce({_IN('negator', 'w[i - 2]')}, false))"
_SENTIMENT = f"""WITH {_TEXTS},
a AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), {q(signals.TOKEN)}) AS t FROM texts),
b AS (SELECT id, t, list_filter(t, lambda x: NOT {_IN('intensifier', 'x')}) AS w FROM a),
c AS (SELECT id, CAST(sum(CASE WHEN {_IN('negator', 'w[i]')} THEN 0 ELSE CAST({_IN('positive', 'w[i]')} AND NOT {_NEGATED} AS INTEGER) + CAST({_IN('negative', 'w[i]')} AND {_NEGATED} AS INTEGER) END) AS INTEGER) AS positive,
  CAST(sum(CASE WHEN {_IN('negator', 'w[i]')} THEN 0 ELSE CAST({_IN('negative', 'w[i]')} AND NOT {_NEGATED} AS INTEGER) + CAST({_IN('positive', 'w[i]')} AND {_NEGATED} AS INTEGER) END) AS INTEGER) AS negative FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM b) GROUP BY id),
d AS (SELECT b.id, t, w, coalesce(positive, 0) AS positive, coalesce(negative, 0) AS negative, least(1.0, (coalesce(positive, 0) + coalesce(negative, 0)) / greatest(1, len(t)) * 5.0) AS raw, list_has_any(t, [{', '.join(map(q, signals.LEXICON['intensifier']))}]) AS strong FROM b LEFT JOIN c USING (id))
SELECT id, CASE WHEN positive > negative THEN 'positive' WHEN negative > positive THEN 'negative' ELSE 'neutral' END AS valence,
  CASE WHEN positive + negative = 0 THEN 0.0::DOUBLE ELSE round(CASE WHEN strong THEN least(1.0, raw * 1.5) ELSE raw END, 3) END AS intensity,
  array_to_string(list_filter([{', '.join(f"CASE WHEN list_has_any(w, [{', '.join(map(q, v))}]) THEN '{k}' END" for k, v in sorted(signals.EMOTIONS.items()))}], lambda x: x IS NOT NULL), ',') AS emotions, positive, negative FROM d"""


@register("sc9_sentiment", _SENTIMENT)
def sc9(spark: SparkSession, sf: str) -> DataFrame:
    return texts(Tables(spark, sf)).select("id", signals.sentiment(F.col("text")).alias("s")).select("id", "s.*")


_HITS = " UNION ALL ".join(f"SELECT doc_id, {i} AS turn, {q(n)} AS pattern, {s} AS severity, regexp_extract_all(text, {q(p)}) AS h, string_split_regex(text, {q(p)}) AS g FROM documents WHERE text IS NOT NULL" for i, (n, s, p) in enumerate(signals.SENSITIVE))
_SPANS = f"""h AS ({_HITS}),
each AS (SELECT doc_id, turn, pattern, severity, h[n] AS hit, CAST(list_sum(list_transform(g[1:n], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:n - 1], lambda x: length(x))), 0) AS INTEGER) AS a FROM (SELECT *, unnest(range(1, len(h) + 1)) AS n FROM h WHERE len(h) > 0)),
luhn AS (SELECT DISTINCT hit FROM each WHERE pattern = 'Credit Card' AND list_sum(list_transform(range(1, length(hit) + 1), lambda i: CASE WHEN i % 2 = 0 THEN (CAST(reverse(hit)[i] AS INTEGER) * 2) // 10 + (CAST(reverse(hit)[i] AS INTEGER) * 2) % 10 ELSE CAST(reverse(hit)[i] AS INTEGER) END)) % 10 = 0),
good AS (SELECT doc_id, turn, pattern, severity, a, a + length(hit) AS z FROM each WHERE CASE pattern WHEN 'Credit Card' THEN hit IN (SELECT hit FROM luhn) WHEN 'SSN' THEN NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$') ELSE true END),
once AS (SELECT doc_id, a, z, min(turn) AS turn, arg_min(pattern, turn) AS pattern, arg_min(severity, turn) AS severity FROM good GROUP BY doc_id, a, z),
reach AS (SELECT *, max(z) OVER (PARTITION BY doc_id ORDER BY a, z, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM once),
spans AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, z, turn) AS span FROM reach),
merged AS (SELECT doc_id, first(pattern ORDER BY severity DESC, a, z, turn) AS pattern, CAST(max(severity) AS INTEGER) AS severity, min(a) AS "start", CAST(max(z) AS INTEGER) AS "end" FROM spans GROUP BY doc_id, span)"""


@register("dd6_sensitive_spans", f"WITH {_SPANS} SELECT * FROM merged")
def dd6(spark: SparkSession, sf: str) -> DataFrame:
    return signals.sensitive_spans(Tables(spark, sf).read("documents"))


@register(
    "dd7_redacted",
    f"""WITH {_SPANS}, s AS (SELECT doc_id, list({{'a': "start", 'z': "end"}} ORDER BY "start") AS s FROM merged GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(len(s), 0) AS INTEGER) AS spans, CASE WHEN s IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(s) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE s[i - 1].z + 1 END, s[i].a - CASE WHEN i = 1 THEN 0 ELSE s[i - 1].z END) || '[REDACTED]'), '') || substr(text, s[len(s)].z + 1) END AS text
    FROM documents d LEFT JOIN s USING (doc_id)""",
)
def dd7(spark: SparkSession, sf: str) -> DataFrame:
    return signals.redacted(Tables(spark, sf).read("documents"))


def _cleaned() -> str:
    out = "text"
    for pattern, by in signals.NOISE:
        flags = "g"
        if pattern.startswith("(?im)"):
            pattern = "(?im)" + pattern[5:]
        out = f"regexp_replace({out}, {q(pattern)}, {q(by) if by.strip() or not by else 'repeat(chr(10), ' + str(len(by)) + ')'}, '{flags}')"
    return f"regexp_replace(substr({out}, 1, 50000), '\\s+$', '', 'g')"


@register(
    "dd9_clean_capture",
    f"""WITH {_TEXTS}, c AS (SELECT id, text, {_cleaned()} AS c FROM texts),
    r AS (SELECT *, CASE WHEN text IS NULL OR regexp_replace(text, '\\s', '', 'g') = '' THEN 'empty_input' WHEN length(c) < 20 AND length(text) >= 20 THEN 'synthetic_noise' WHEN length(c) < 20 THEN 'too_short' WHEN length(c) < 0.05 * length(text) AND length(text) > 500 THEN 'mostly_noise' ELSE 'ok' END AS reason FROM c)
    SELECT id, CASE WHEN reason = 'ok' THEN c ELSE '' END AS content, reason = 'ok' AS accepted, reason FROM r""",
)
def dd9(spark: SparkSession, sf: str) -> DataFrame:
    return texts(Tables(spark, sf)).select("id", signals.clean_capture(F.col("text")).alias("c")).select("id", "c.*")
