"""What model, extractor and folder names say."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed hints that a model reads images.
VISION_HINTS = ["qwen3-vl", "qwen2.5-vl", "qwen2-vl", "llava-onevision", "llava-next", "llava", "openvla", "internvl", "-vl-", "-vl/"]
#: Fixed pixels a side of the patches that a model family merges.
PIXEL_FACTORS = {"qwen3-vl": 32, "qwen2.5-vl": 28, "qwen2-vl": 28}
#: Signs between a prefix and a model's name.
MARKS = "[-_:]"


def _has(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in parts])


def is_vision_model(model_id: Column) -> Column:
    return _has(model_id, *VISION_HINTS)


def pixel_factor(model_id: Column) -> Column:
    """Pixels of a merged patch's side, or null for other families."""
    return F.coalesce(*[F.when(_has(model_id, name), F.lit(n)) for name, n in PIXEL_FACTORS.items()])


def has_pixel_limits(model_id: Column) -> Column:
    """Whether images are bounded by a count of pixels."""
    limited = _has(model_id, "llava-next") & ~_has(model_id, "llava-onevision")
    return limited | pixel_factor(model_id).isNotNull()


#: Fixed names of an evaluation harness's models: the first row of which all of one group of parts occur in an id.
HARNESS_MODELS = [
    ("llava_vid", [["llava-video-7b-qwen2"], ["lmms-lab", "llava-video", "qwen2"]]),
    ("llava_hf", [["llava-onevision", "llava-hf"], ["llava_onevision", "llava-hf"]]),
    ("llava_onevision", [["llava-onevision", "lmms-lab"], ["llava_onevision", "lmms-lab"]]),
    ("llava_hf", [["llava-onevision"], ["llava_onevision"], ["llava-next"], ["llava_next"]]),
    ("llava_vid", [["llava", "video"]]),
    ("qwen3_vl", [["qwen3-vl"], ["qwen3_vl"]]),
    ("qwen2_5_vl", [["qwen2.5-vl"], ["qwen2_5-vl"]]),
    ("qwen2_vl", [["qwen2-vl"]]),
]
HARNESS_DEFAULT = "qwen2_5_vl"


def harness_model(model_id: Column) -> Column:
    """The harness's name of a model; null for null."""
    found = [F.when(reduce(or_, [reduce(and_, [_has(model_id, part) for part in parts]) for parts in groups]), F.lit(name)) for name, groups in HARNESS_MODELS]
    return F.when(model_id.isNotNull(), F.coalesce(*found, F.lit(HARNESS_DEFAULT)))


def aliased(values: dict[str, str | None], names: list[str], overridden: set[str]) -> str | None:
    """One setting under several names, the first of which is the chief: where values differ, those that were overridden explicitly count, and among
    these, or among all, the first that isn't blank."""
    held = {n: (values.get(n) or "").strip() for n in names}
    there = [n for n in names if held[n]]
    chosen = [n for n in there if n in overridden] or there
    return held[chosen[0]] if chosen else None


def extractor_spec(spec: Column, providers: list[str]) -> Column:
    """struct(mode, provider, model) of `local`, `local-model`, `provider-model` or a bare remote model's name.

    The sign after a prefix is a hyphen, an underscore or a colon; case is ignored in prefixes. Null and blank are `local`. A
    prefix without a model is an error when the row is read.
    """
    raw = F.trim(F.coalesce(spec, F.lit("local")))
    named = rf"(?is)^({'|'.join(['local', *providers])}){MARKS}(.*)$"
    prefix = F.lower(F.nullif(F.regexp_extract(raw, named, 1), F.lit("")))
    rest = F.trim(F.regexp_extract(raw, named, 2))
    rest = F.when(rest == "", F.raise_error(F.concat(F.lit("no model is named in "), raw))).otherwise(rest)
    local = (raw == "") | (F.lower(raw) == "local")
    return F.struct(
        F.when(local | (prefix == "local"), "local").otherwise("remote").alias("mode"),
        F.when(prefix != "local", prefix).otherwise("").alias("provider"),
        F.when(local, "").when(prefix.isNotNull(), rest).otherwise(raw).alias("model"),
    )


def prepared_dir(base: str, dataset: Column, fps: Column) -> Column:
    """Folder of frames prepared at a rate: `base/dataset/clip_2`, `.../clip_0.5`; up to six decimals of the rate are shown."""
    shown = F.regexp_replace(F.format_string("%.6f", fps.cast("double")), r"\.?0+$", "")
    return F.concat(F.lit(base.rstrip("/") + "/"), F.trim(dataset), F.lit("/clip_"), shown)


def bundle_text(video_id: Column, video_file: Column, questions: Column) -> Column:
    """A video's questions as a text block. questions: array of structs with question_id, question, options, answer, domain, sub_category, task_type."""

    def optional(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{label}: "), value))

    def block(q: Column, at: Column) -> Column:
        options = F.transform(F.coalesce(q["options"], F.array().cast("array<string>")), lambda o: F.concat(F.lit("  "), o))
        first = F.concat(F.lit("[Q"), (at + 1).cast("string"), F.lit("] "), q["question_id"])
        more = [optional("Domain", q["domain"]), optional("Sub Category", q["sub_category"]), optional("Task Type", q["task_type"])]
        return F.concat_ws("\n", first, F.concat(F.lit("Question: "), q["question"]), options, F.concat(F.lit("Answer: "), q["answer"]), *more)

    asked = F.coalesce(questions, F.array().cast("array<struct<question_id:string,question:string,options:array<string>,answer:string,domain:string,sub_category:string,task_type:string>>"))
    head = F.concat(F.lit("Video ID: "), video_id, F.lit("\nVideo File: "), video_file, F.lit("\nQuestion Count: "), F.size(asked).cast("string"))
    return F.concat(F.concat_ws("\n\n", head, F.transform(asked, block)), F.lit("\n"))
