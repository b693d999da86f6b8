"""Answers and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import answers
from framesift.operators import scoring
from framesift.plans import register
from framesift.plans.views import MRA, NUMERIC, SAMPLES, load, numeric, responses, samples

E = r"[^\p{L}\p{N}_]"


@register(
    "flt_task_filter",
    f"WITH {SAMPLES} SELECT k AS wanted, count(*)::BIGINT AS n FROM samples, (VALUES ('all'), ('mcq'), ('generation'), ('en')) t(k) WHERE k = 'all' OR (k = 'mcq' AND is_mcq) OR (k = 'generation' AND NOT is_mcq) OR k = task_type GROUP BY k",
)
def task_filters(spark, sf_dir):
    rows = samples(spark, sf_dir)
    found = None
    for wanted in ("all", "mcq", "generation", "en"):
        one = scoring.filter_tasks(rows, wanted).groupBy(F.lit(wanted).alias("wanted")).agg(F.count(F.lit(1)).alias("n"))
        found = one if found is None else found.unionByName(one)
    return found


def _choices(spark, sf_dir):
    rows = samples(spark, sf_dir).where("options IS NOT NULL")
    return rows.select(F.col("task_type").alias("task"), F.lit(None).cast("double").alias("truth_number"), F.lit(None).cast("double").alias("number"), F.lit(True).alias("is_mcq"), "truth", "answer")


def _scored_samples(spark, sf_dir):
    return _choices(spark, sf_dir).unionByName(numeric(spark, sf_dir))


_ALL = f"""WITH {SAMPLES}, {NUMERIC}, mc AS (SELECT count(*) FILTER (truth = answer) AS correct, count(*) AS n FROM samples WHERE is_mcq),
nu AS (SELECT sum({MRA}) AS mra, count(p) AS n FROM numbers)"""


@register("agg_accuracy_all", f"{_ALL} SELECT round(100.0 * (correct + mra) / (mc.n + nu.n), 6)::DOUBLE AS accuracy FROM mc, nu")
def accuracy_all(spark, sf_dir):
    return scoring.accuracy(scoring.tally(_scored_samples(spark, sf_dir), []), "all").select("accuracy")


@register(
    "agg_accuracy_by_task",
    f"WITH {SAMPLES} SELECT task_type AS task, (count(*) FILTER (truth = answer))::BIGINT AS correct, count(*)::BIGINT AS n_mcq, round(100.0 * count(*) FILTER (truth = answer) / count(*), 6)::DOUBLE AS accuracy FROM samples WHERE is_mcq GROUP BY 1",
)
def accuracy_by_task(spark, sf_dir):
    return scoring.accuracy(scoring.tally(_choices(spark, sf_dir), ["task"]), "mcq").select("task", "correct", "n_mcq", "accuracy")


def _mra(mode):
    count = "count(p)" if mode == "skip" else "count(*)"
    return f"WITH {NUMERIC} SELECT task, {count}::BIGINT AS n_numeric, round(100.0 * coalesce(sum({MRA}), 0) / {count}, 6)::DOUBLE AS accuracy FROM numbers GROUP BY 1"


@register("agg_mra_skip", _mra("skip"))
def mra_skip(spark, sf_dir):
    return scoring.accuracy(scoring.tally(numeric(spark, sf_dir), ["task"]), "numeric").select("task", "n_numeric", "accuracy")


@register("agg_mra_count", _mra("zero"))
def mra_count(spark, sf_dir):
    return scoring.accuracy(scoring.tally(numeric(spark, sf_dir), ["task"], unparsed="zero"), "numeric").select("task", "n_numeric", "accuracy")


@register("agg_score_counts", f"{_ALL} SELECT correct::BIGINT AS correct, mc.n::BIGINT AS n_mcq, round(mra, 4)::DOUBLE AS mra_sum, nu.n::BIGINT AS n_numeric FROM mc, nu")
def score_counts(spark, sf_dir):
    return scoring.tally(_scored_samples(spark, sf_dir), []).select("correct", "n_mcq", F.round("mra_sum", 4).alias("mra_sum"), "n_numeric")


@register(
    "agg_overlimit",
    "SELECT role, (count(*) FILTER (length(text) > 400))::BIGINT AS over_limit, (count(*) FILTER (NOT contains(text, '</think>')))::BIGINT AS no_think_end FROM conversations GROUP BY role",
)
def over_limit(spark, sf_dir):
    rows = responses(spark, sf_dir)
    return rows.groupBy("role").agg(F.count_if(F.char_length("response") > 400).alias("over_limit"), F.count_if(~answers.usable(F.col("response"), F.lit(True))).alias("no_think_end"))


_LETTER = rf"nullif(regexp_extract(upper(text), '(?:^|{E})([A-F])(?:$|{E})', 1), '')"
_NUMBER = r"nullif(regexp_extract(text, '([-+]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+))', 1), '')"


@register("parse_answer_letter", f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, {_LETTER} AS letter FROM conversations")
def parse_letter(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", answers.letter(F.col("response")).alias("letter"))


@register("parse_answer_number", f"SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, {_NUMBER} AS number FROM conversations")
def parse_number(spark, sf_dir):
    return responses(spark, sf_dir).select("conv_id", "turn", answers.number(F.col("response")).alias("number"))


_FINAL = """said AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text AS whole, trim(CASE WHEN contains(text, '</think>') THEN substr(text, strpos(text, '</think>') + 8) ELSE text END) AS rest FROM conversations),
final AS (SELECT *, coalesce(nullif(trim(regexp_extract(rest, '(?is)<answer>(.*?)</answer>', 1)), ''), rest) AS text FROM said)"""


@register("parse_answer_full", f"WITH {_FINAL} SELECT conv_id, turn, coalesce(CASE WHEN role = 'assistant' THEN {_LETTER} END, {_NUMBER}, whole) AS answer FROM final")
def parse_full(spark, sf_dir):
    """Every turn; those of the assistant are answers to questions with options."""
    return responses(spark, sf_dir).select("conv_id", "turn", answers.parse_answer(F.col("response"), has_options=F.col("role") == "assistant").alias("answer"))


def _marked(spark, sf_dir):
    """Every turn in four forms: as it is, after thinking, as an <answer>, as an object's final answer."""
    text = F.col("response")
    forms = F.array(text, F.concat(F.lit("A B </think> "), text), F.concat(F.lit("so <ANSWER> "), text, F.lit(" </answer> 7")), F.concat(F.lit("C {'final_answer': '"), F.translate(text, "'\"{}\\\n\r\t", ""), F.lit("'} end")))
    return responses(spark, sf_dir).select("conv_id", "turn", F.posexplode(forms).alias("form", "response"))


_MARKED = """forms AS (SELECT conv_id, turn, unnest([0, 1, 2]) AS form, unnest([text, 'A B </think> ' || text, 'so <ANSWER> ' || text || ' </answer> 7']) AS whole FROM conversations),
said AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, form, whole, trim(CASE WHEN contains(whole, '</think>') THEN substr(whole, strpos(whole, '</think>') + 8) ELSE whole END) AS rest FROM forms),
final AS (SELECT *, coalesce(nullif(trim(regexp_extract(rest, '(?is)<answer>(.*?)</answer>', 1)), ''), rest) AS text FROM said)"""


@register("parse_marked_answers", f"WITH {_MARKED} SELECT conv_id, turn, form::BIGINT AS form, coalesce({_LETTER}, {_NUMBER}, whole) AS answer FROM final")
def parse_marked(spark, sf_dir):
    rows = _marked(spark, sf_dir).where("form < 3")
    return rows.select("conv_id", "turn", F.col("form").cast("bigint").alias("form"), answers.parse_answer(F.col("response")).alias("answer"))


@register(
    "answer_from_object",
    rf"""WITH s AS (SELECT conv_id, turn, upper(trim(translate(text, chr(39) || '"{{}}' || chr(92) || chr(10) || chr(13) || chr(9), ''))) AS said FROM conversations)
SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, CASE WHEN regexp_matches(said, '^(-1|[0-4])$') THEN said::INT WHEN regexp_matches(said, '^[A-E]$') THEN ascii(said) - 65 ELSE nullif(regexp_extract(said, '(?:^|{E})([0-4])(?:$|{E})', 1), '')::INT END::BIGINT AS place FROM s""",
)
def from_object(spark, sf_dir):
    rows = _marked(spark, sf_dir).where("form = 3")
    return rows.select("conv_id", "turn", answers.answer_index(F.col("response")).cast("bigint").alias("place"))


@register(
    "choice_letters",
    rf"""SELECT d.doc_id::BIGINT AS sample_id, coalesce(CASE WHEN regexp_matches(upper(trim(d.lang)), '^[A-F]$') THEN upper(trim(d.lang)) END, nullif(regexp_extract(upper(trim(d.lang)), '(?:^|{E})([A-F])(?:$|{E})', 1), ''),
  CASE lower(trim(d.lang)) WHEN 'de' THEN 'A' WHEN 'en' THEN 'B' WHEN 'fr' THEN 'C' END, trim(d.lang)) AS letter FROM documents d""",
)
def choice_letters(spark, sf_dir):
    options = F.array(F.lit("DE"), F.lit(" en"), F.lit("Fr"))
    return load(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("sample_id"), answers.choice_letter(F.col("lang"), options).alias("letter"))


@register(
    "prompt_texts",
    """WITH s AS (SELECT doc_id::BIGINT AS sample_id, coalesce(source, 'no source') AS source, quality IS NOT NULL AS mc FROM documents LEFT JOIN labels USING (doc_id))
SELECT sample_id, CASE WHEN mc THEN source || E'\n\nOptions:\nA. no\nB. yes\n\nDirectly answer with the option letter only. Do not explain.' ELSE source || E'\n\nPlease provide the numerical answer directly.' END AS prompt,
  CASE WHEN mc THEN E'a video frame relevant to the following question and options:\n' || source || E'\nOptions:\nA. no\nB. yes' END AS query,
  CASE WHEN mc THEN 'Question: ' || source || E'\nAnswer: yes' ELSE source END AS focus FROM s""",
)
def prompts(spark, sf_dir):
    rows = samples(spark, sf_dir)
    asked = F.coalesce("dataset", F.lit("no source"))
    return rows.select(
        "sample_id",
        answers.question_prompt(asked, F.col("options")).alias("prompt"),
        F.when(F.col("options").isNotNull(), answers.retrieval_text(asked, F.col("options"))).alias("query"),
        answers.focus_query(asked, F.when(F.col("options").isNotNull(), F.lit("yes"))).alias("focus"),
    )


@register(
    "norm_answer_letter",
    "SELECT l_linenumber::BIGINT AS given, (CASE WHEN l_linenumber <= 4 THEN substr('ABCDE', l_linenumber + 1, 1) WHEN l_linenumber = 5 THEN 'E' ELSE l_linenumber::VARCHAR END) AS letter, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2",
)
def norm_letter(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("given")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("given", answers.normalize_choice(F.col("given").cast("string")).alias("letter"), "n")


@register(
    "label_options",
    r"SELECT item_id::BIGINT AS item_id, array_to_string(list_transform(list_filter(list_zip(string_split(text, '.'), range(0, len(string_split(text, '.')))), lambda x: trim(x[1], E' \n') <> ''), lambda x: chr((x[2] + 65)::INT) || '. ' || coalesce(nullif(trim(regexp_replace(trim(x[1], E' \n'), '^[A-Za-z][.):-]\s*', '')), ''), trim(x[1], E' \n'))), chr(10)) AS labelled FROM benchmark",
)
def labelled_options(spark, sf_dir):
    options = F.transform(F.split(F.col("text"), r"\."), lambda o: F.btrim(o, F.lit(" \n")))
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").cast("bigint").alias("item_id"), answers.label_options(options).alias("labelled"))


@register("flt_allowed_tasks", "SELECT doc_id::BIGINT AS sample_id FROM documents WHERE lower(lang) IN ('en', 'de')")
def allowed(spark, sf_dir):
    return scoring.allowed_tasks(samples(spark, sf_dir), ["EN", "de"]).select("sample_id")


@register("agg_outcomes", "SELECT o_orderpriority AS kind, count(*)::BIGINT AS n, (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS success, (count(*) FILTER (o_orderstatus <> 'F'))::BIGINT AS failed FROM orders GROUP BY 1")
def outcomes(spark, sf_dir):
    return scoring.outcome_counts(load(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "kind"), ["kind"], status="o_orderstatus", good="F")


@register("agg_safe_mean", "SELECT l_returnflag AS task, coalesce(round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6), 0)::DOUBLE AS mean_open FROM lineitem GROUP BY 1")
def safe_means(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task"))
    return rows.agg(F.round(scoring.safe_mean(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 6).alias("mean_open"))


_RUN = "SELECT l_orderkey::BIGINT AS id, array_agg(l_linenumber::BIGINT ORDER BY l_linenumber, l_partkey) AS steps, array_agg(-l_quantity / 50.0 ORDER BY l_linenumber, l_partkey) AS lp FROM lineitem GROUP BY 1"


@register(
    "answer_span_probability",
    f"WITH r AS ({_RUN}), p AS (SELECT *, list_position(list_transform(range(1, len(steps)), lambda i: steps[i : i + 1] = [2, 3]), true) AS hit FROM r) SELECT id, (hit - 1)::BIGINT AS start, round(exp((lp[hit] + lp[hit + 1]) / 2), 6)::DOUBLE AS prob FROM p WHERE hit > 0",
)
def span_probability(spark, sf_dir):
    from framesift.functions import vectors

    rows = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("bigint").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").cast("bigint").alias("step"), "l_partkey", (-F.col("l_quantity") / 50.0).alias("lp")))).alias("s"))
    span = vectors.first_run(F.col("s.step"), F.array(F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))
    found = rows.select("id", "s", span.alias("span")).where("span IS NOT NULL")
    return found.select("id", F.col("span.start").cast("bigint").alias("start"), F.round(vectors.mean_probability(F.slice(F.col("s.lp"), F.col("span.start") + 1, F.lit(2))), 6).alias("prob"))
