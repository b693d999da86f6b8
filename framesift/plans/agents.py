"""Selection by rounds: an agent that asks for captions, and iterative answering with an early stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators import agent, iterative
from framesift.plans import register
from framesift.plans.views import load

MODEL, BUDGET = "replay", 6


def _rule(calls: DataFrame) -> DataFrame:
    """Answers by the call's key alone, as a table of recorded responses would."""

    def drawn(place: int, n: int) -> Column:
        return (F.conv(F.substring("call_key", place, 2), 16, 10).cast("int") % n).cast("string")

    answer = F.concat(F.lit('{"final_answer": '), drawn(1, 5), F.lit("}"))
    rating = F.concat(F.lit('so {"confidence": '), (drawn(1, 3).cast("int") + 1).cast("string"), F.lit("}"))
    named = F.concat(F.lit('{"frame_descriptions": [{"segment_id": '), drawn(1, 6), F.lit(', "description": "x"}, {"segment_id": "'), drawn(3, 4), F.lit('"}]}'))
    return calls.withColumn("response", F.when(F.col("step") == "answer", answer).when(F.col("step") == "confidence", rating).otherwise(named))


def _captioned(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as videos: their lines are captions, the language is the question; a caption's score is its length."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("sample"), F.col("lang").alias("question"), F.split("text", "\n").alias("captions"))
    scores = docs.select("sample", F.posexplode("captions").alias("pos", "caption")).select("sample", (F.col("pos") + 1).alias("idx"), F.char_length("caption").cast("double").alias("score"))
    return docs, scores


def _key(prompt: str) -> str:
    return f"md5('{MODEL}' || chr(10) || '{agent.SYSTEM}' || chr(10) || {prompt})"


def _drawn(key: str, place: int, n: int) -> str:
    return f"(('0x' || substr({key}, {place}, 2))::INT % {n})"


#: The prompts of the second and third kind of call, as SQL.
_JUDGED = """(prompt || chr(10) || 'The answer was: {"final_answer": ' || answer || '}' || chr(10) || 'Rate how far the captions support it (1 hardly, 2 partly, 3 fully): {"confidence": rating}')"""
_DESCRIBED = """(prompt || chr(10) || 'These captions are not enough. Segments between them: ' || array_to_string([j || ': ' || chosen[j] || '-' || chosen[j + 1] FOR j IN range(1, len(chosen))], ', ')
  || chr(10) || 'Name those worth a look: {"frame_descriptions": [{"segment_id": number, "description": text}]}')"""


def _asked(i: int) -> str:
    return f"""asked{i} AS (
  SELECT *, 'A video has ' || n || ' captioned frames. Some of them:' || chr(10) || array_to_string(['frame ' || x || ': ' || caps[x] FOR x IN chosen], chr(10))
    || chr(10) || 'Question: ' || question || chr(10) || 'Reply with the index of the best answer: {{"final_answer": index}}' AS prompt FROM state{i}
),
said{i} AS (SELECT *, {_drawn(_key("prompt"), 1, 5)} AS answer FROM asked{i}),
round{i} AS (SELECT *, {_drawn(_key(_JUDGED), 1, 3)} + 1 AS confidence FROM said{i})"""


def _state(i: int) -> str:
    return f"""seg{i} AS (SELECT *, {_key(_DESCRIBED)} AS k FROM round{i - 1} WHERE confidence < {agent.SURE}),
best{i} AS (
  SELECT sample, segment, max({{'score': chars, 'earlier': -idx}}) AS best FROM (
    SELECT sample, caps, chosen, unnest(list_distinct([{_drawn('k', 1, 6)}, {_drawn('k', 3, 4)}])) AS segment FROM seg{i}
  ), LATERAL (SELECT idx, length(caps[idx]) AS chars FROM range(1, len(caps) + 1) t(idx)) WHERE segment BETWEEN 1 AND len(chosen) - 1 AND idx > chosen[segment] AND idx < chosen[segment + 1]
  GROUP BY sample, segment
),
state{i} AS (
  SELECT sample, question, caps, n, list_sort(list_distinct(list_concat(chosen, coalesce(added, [])))) AS chosen
  FROM seg{i} LEFT JOIN (SELECT sample, list(-best.earlier) AS added FROM best{i} GROUP BY sample) USING (sample)
)"""


_AGENT = f"""state1 AS (
  SELECT sample, question, caps, n, list_sort(list_distinct([floor(1 + i * ((n - 1) / 4.0::DOUBLE))::BIGINT FOR i IN range(5)])) AS chosen
  FROM (SELECT doc_id::BIGINT AS sample, coalesce(lang, '') AS question, string_split(text, chr(10)) AS caps, len(string_split(text, chr(10))) AS n FROM documents) WHERE n >= 2
),
{_asked(1)}, {_state(2)}, {_asked(2)}, {_state(3)}, {_asked(3)},
rounds AS (SELECT sample, 1 AS round, chosen, answer, confidence FROM round1 UNION ALL SELECT sample, 2, chosen, answer, confidence FROM round2 UNION ALL SELECT sample, 3, chosen, answer, NULL FROM said3)"""
_LISTED = "array_to_string(chosen, ',')"


@register("sel_agent_rounds", f"WITH {_AGENT} SELECT sample, round::BIGINT AS round, {_LISTED} AS chosen, answer::BIGINT AS answer, confidence::BIGINT AS confidence FROM rounds")
def rounds(spark, sf_dir):
    found = agent.agent_rounds(*_captioned(spark, sf_dir), _rule, model=MODEL)
    return found.select("sample", F.col("round").cast("bigint").alias("round"), F.array_join("chosen", ",").alias("chosen"), F.col("answer").cast("bigint").alias("answer"), F.col("confidence").cast("bigint").alias("confidence"))


@register(
    "sel_agent",
    f"""WITH {_AGENT}, last AS (SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY sample ORDER BY round DESC) = 1)
SELECT sample, round::BIGINT AS rounds, answer::BIGINT AS answer, array_to_string(CASE WHEN len(chosen) > {BUDGET}
  THEN [chosen[1 + CASE WHEN i = {BUDGET} - 1 THEN len(chosen) - 1 ELSE floor(i * ((len(chosen) - 1) / {BUDGET - 1}.0::DOUBLE))::BIGINT END] FOR i IN range({BUDGET})] ELSE chosen END, ',') AS chosen FROM last""",
)
def selected(spark, sf_dir):
    found = agent.pick_agent(*_captioned(spark, sf_dir), _rule, BUDGET, model=MODEL)
    return found.select("sample", F.col("rounds").cast("bigint").alias("rounds"), F.col("answer").cast("bigint").alias("answer"), F.array_join("chosen", ",").alias("chosen"))


def _asked_rounds(spark, sf_dir) -> DataFrame:
    """Orders as samples, their lines as rounds: the flag is the answer, the quantity its probability, part and supplier the frames."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("sample"),
        F.row_number().over(order).cast("bigint").alias("round"),
        F.when(F.col("l_linestatus") == "O", F.translate("l_returnflag", "ANR", "Abz")).when(F.col("l_returnflag") != "R", F.lit(" a")).alias("answer"),
        (F.col("l_quantity") / 50.0).alias("prob"),
        (F.col("l_orderkey") % 5 != 0).alias("has_options"),
        F.array(F.col("l_partkey") % 7, F.col("l_suppkey") % 5, F.lit(0).cast("bigint")).alias("frames"),
    )


#: The loop as a recursion: each step has the state after a round, and a stopped sample has no next one.
_FOLD = """RECURSIVE given AS (
  SELECT l_orderkey::BIGINT AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS round,
    CASE WHEN l_linestatus = 'O' THEN translate(l_returnflag, 'ANR', 'Abz') WHEN l_returnflag <> 'R' THEN ' a' END AS answer, l_quantity / 50.0::DOUBLE AS prob,
    l_orderkey % 5 <> 0 AS has_options, [l_partkey % 7, l_suppkey % 5, 0]::BIGINT[] AS frames FROM lineitem
),
marked AS (SELECT *, CASE WHEN has_options AND prob > 0.3 AND upper(trim(answer)) IN ('A', 'B', 'C', 'D') THEN upper(trim(answer)) END AS letter FROM given),
folded AS (
  SELECT sample, 1::BIGINT AS round, answer, letter, CASE WHEN letter IS NULL THEN 0 ELSE 1 END::BIGINT AS streak, list_distinct(frames) AS seen, len(frames) - len(list_distinct(frames)) AS hits FROM marked WHERE round = 1
  UNION ALL
  SELECT m.sample, m.round, coalesce(m.answer, f.answer), m.letter, CASE WHEN m.letter IS NULL THEN 0 WHEN m.letter = f.letter THEN f.streak + 1 ELSE 1 END,
    list_distinct(list_concat(f.seen, m.frames)), f.hits + len(m.frames) + len(f.seen) - len(list_distinct(list_concat(f.seen, m.frames)))
  FROM folded f JOIN marked m ON m.sample = f.sample AND m.round = f.round + 1 WHERE f.streak < 2
)"""


@register("sel_iterative_fold", f"WITH {_FOLD} SELECT sample, round, answer, streak, streak >= 2 AS stopped, hits::BIGINT AS hits, len(seen)::BIGINT AS misses FROM folded")
def folded(spark, sf_dir):
    return iterative.fold_rounds(_asked_rounds(spark, sf_dir), streak=2, threshold=0.3)


@register(
    "sel_iterative",
    f"WITH {_FOLD} SELECT sample, coalesce(answer, '') AS answer, round AS rounds_used, streak >= 2 AS stopped, hits::BIGINT AS hits, len(seen)::BIGINT AS misses FROM folded QUALIFY row_number() OVER (PARTITION BY sample ORDER BY round DESC) = 1",
)
def iterated(spark, sf_dir):
    return iterative.results(iterative.fold_rounds(_asked_rounds(spark, sf_dir), streak=2, threshold=0.3))
