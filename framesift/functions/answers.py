"""Reading answers out of model responses, and scoring them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from framesift.functions import draws

END_OF_THINK = "</think>"
#: A letter between characters that are neither letters, digits nor underscore, in any script.
EDGE = r"[^\p{L}\p{N}_]"


def _nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def after_think(text: Column, mark: str = END_OF_THINK) -> Column:
    """What follows the first end-of-think mark; the whole text without one."""
    at = F.instr(text, mark)
    return F.trim(F.when(at > 0, F.substr(text, at + len(mark))).otherwise(text))


def inline_answer(text: Column) -> Column:
    """Content of the first <answer> element, or null."""
    return _nonempty(F.trim(F.regexp_extract(text, r"(?is)<answer>(.*?)</answer>", 1)))


def letter(text: Column, letters: str = "A-F") -> Column:
    """First letter of the range that stands alone in the upper-cased text, or null. It takes an article `a` for an answer."""
    return _nonempty(F.regexp_extract(F.upper(text), rf"(?:^|{EDGE})([{letters}])(?:$|{EDGE})", 1))


def number(text: Column) -> Column:
    """First number as text, or null; it may have a sign and begin with a point."""
    return _nonempty(F.regexp_extract(text, r"([-+]?(?:[0-9]+\.[0-9]+|[0-9]+|\.[0-9]+))", 1))


def parse_answer(text: Column, letters: str = "A-F", has_options: Column | None = None) -> Column:
    """Of the part after thinking, and inside <answer> if there is one: a letter where the sample has options, else a number; the whole text where there is neither."""
    final = after_think(text)
    final = F.coalesce(inline_answer(final), final)
    chosen = letter(final, letters) if has_options is None else F.when(has_options, letter(final, letters))
    return F.coalesce(chosen, number(final), text)


def normalize_choice(answer: Column) -> Column:
    """A-E from a letter, an index 0-4 or the digit 5 (the only one read as counted from one); anything else stays as it is, trimmed."""
    raw = F.trim(answer)
    index = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("int"))
    by_index = F.when(index.between(0, 4), F.substr(F.lit("ABCDE"), index + 1, F.lit(1)))
    return F.when(F.upper(raw).rlike("^[A-E]$"), F.upper(raw)).otherwise(F.coalesce(by_index, F.when(index == 5, F.lit("E")), raw))


def choice_letter(answer: Column, options: Column) -> Column:
    """A-F: the answer itself, else a letter that stands alone, else the letter of the option with the same text (case ignored); else the answer, trimmed."""
    raw = F.trim(answer)
    place = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(raw))
    by_option = F.when(place > 0, F.char(place + 64))
    return F.coalesce(F.when(F.upper(raw).rlike("^[A-F]$"), F.upper(raw)), letter(raw), by_option, raw)


def relative_accuracy(predicted: Column, truth: Column) -> Column:
    """max(0, 1 - |p - g| / |g|); for g = 0 it is 1 where p = 0, else 0. Null where p or g is null."""
    near = F.greatest(F.lit(0.0), 1 - F.try_divide(F.abs(predicted - truth), F.abs(truth)))
    zero = F.when(predicted == 0, 1.0).otherwise(0.0)
    return F.when(predicted.isNull() | truth.isNull(), None).when(truth == 0, zero).otherwise(near)


def usable(text: Column, required: Column) -> Column:
    """Whether an answer counts: it has ended its thinking, or need not."""
    return F.contains(text, F.lit(END_OF_THINK)) | ~required


def label_options(options: Column) -> Column:
    """`A. text` lines. Blank options are skipped but keep their letter; a prefix `A.`, `A)`, `A:` or `A-` is replaced, unless it is all there is."""

    def labelled(option: Column, i: Column) -> Column:
        text = F.trim(option)
        bare = F.trim(F.regexp_replace(text, r"^[A-Za-z][.):-]\s*", ""))
        return F.struct(i.alias("i"), F.coalesce(_nonempty(bare), text).alias("o"))

    kept = F.filter(F.transform(options, labelled), lambda x: F.coalesce(x["o"], F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.char(x["i"] + 65), F.lit(". "), x["o"])), "\n")


#: Fixed wording of prompts and queries, on which recorded results depend.
ASK_LETTER = "Directly answer with the option letter only. Do not explain."
ASK_NUMBER = "Please provide the numerical answer directly."
SUBTITLES_HEAD = "This video's subtitles are listed below:"
NO_SUBTITLES = "No subtitles available"
SUBTITLES_ASK = "Select the best answer to the following multiple-choice question based on the video. Respond with only the letter of the correct option."
SUBTITLES_TAIL = "The best answer is:"
RETRIEVAL_HEAD = "a video frame relevant to the following question and options:"
DEFAULT_QUERY = "What is happening in this video?"


def _with_options(question: Column, options: Column) -> Column:
    return F.concat(question, F.lit("\n\nOptions:\n"), label_options(options))


def question_prompt(question: Column, options: Column, subtitles: Column | None = None) -> Column:
    """What a model is asked; with subtitles (a text, lines joined) they come first and a letter is asked for."""
    if subtitles is None:
        choice = F.concat(_with_options(question, options), F.lit(f"\n\n{ASK_LETTER}"))
        return F.when(F.size(options) > 0, choice).otherwise(F.concat(question, F.lit(f"\n\n{ASK_NUMBER}")))
    shown = F.coalesce(_nonempty(F.trim(subtitles)), F.lit(NO_SUBTITLES))
    listed = F.coalesce(label_options(options), F.lit(""))
    return F.concat(F.lit(f"{SUBTITLES_HEAD}\n"), shown, F.lit(f"\n\n{SUBTITLES_ASK}\n"), question, F.lit("\n\nOptions:\n"), listed, F.lit(f"\n{SUBTITLES_TAIL}"))


def retrieval_text(question: Column, options: Column) -> Column:
    """What frames are compared with. A blank question, no options or a blank one among them is an error."""
    blank = F.coalesce(F.trim(question) == "", F.lit(True)) | F.coalesce(F.size(options) <= 0, F.lit(True)) | F.exists(options, lambda o: F.coalesce(F.trim(o) == "", F.lit(True)))
    text = F.concat(F.lit(f"{RETRIEVAL_HEAD}\n"), F.trim(question), F.lit("\nOptions:\n"), label_options(options))
    return F.when(blank, F.raise_error(F.lit("retrieval needs a question and options, none of them blank"))).otherwise(text)


#: Fixed wording of queries that go by the question, as above.
FIND_FRAMES = "Find frames that best support answering the video question."
GOOD_FRAME = "Is this a good frame can answer the question?"


def question_query(question: Column) -> Column:
    """The question alone; a blank one is an error."""
    bare = _nonempty(F.trim(question))
    return F.when(bare.isNull(), F.raise_error(F.lit("retrieval needs a question"))).otherwise(bare)


def open_query(question: Column, options: Column) -> Column:
    """The question with its options where none is blank, the question alone, or a default sentence; never an error."""
    bare = _nonempty(F.trim(question))
    usable_options = F.coalesce((F.size(options) > 0) & ~F.exists(options, lambda o: F.coalesce(F.trim(o) == "", F.lit(True))), F.lit(False))
    listed = F.concat(bare, F.lit("\nOptions:\n"), label_options(options))
    return F.coalesce(F.when(usable_options, listed).otherwise(bare), F.lit(FIND_FRAMES))


def good_frame_query(question: Column, options: Column) -> Column:
    """Question and options as a yes-or-no question about a frame; blank ones are errors as in retrieval_text."""
    text = F.regexp_replace(retrieval_text(question, options), f"^{RETRIEVAL_HEAD}\n", "")
    return F.concat(F.lit("Question: "), text, F.lit(f". {GOOD_FRAME}"))


def candidate_prompt(question: Column, options: Column, pre: str = "", post: str = "") -> Column:
    """The question and its options as lettered lines between two given texts. N/A is no option; blank ones keep their place; letters count those kept."""
    kept = F.filter(F.transform(options, lambda o: F.trim(o)), lambda o: o.isNotNull() & (F.upper(o) != "N/A"))
    lines = F.transform(kept, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o))
    return F.concat(F.lit(pre), question, F.lit("\n"), F.coalesce(F.array_join(lines, "\n"), F.lit("")), F.lit(f"\n{post}"))


def focus_query(question: Column, answer: Column) -> Column:
    """Question and answer, or the one that is there, or a default sentence."""
    q, a = (_nonempty(F.trim(c)) for c in (question, answer))
    both = F.concat(F.lit("Question: "), q, F.lit("\nAnswer: "), a)
    return F.coalesce(both, q, a, F.lit(DEFAULT_QUERY))


#: Fixed keys of a model's reply.
REPLY_KEYS = ("final_answer", "confidence")


def response_object(text: Column, *keys: str) -> Column:
    """The object that a response holds, as JSON text: the whole of it if it is one object (which may hold others), else of the shortest
    {...} runs the last that parses and has one of the keys, else the last that parses. Single quotes serve as double ones."""

    def parsed(t: Column) -> Column:
        quoted = F.translate(t, "'", '"')
        return F.when(F.get_json_object(t, "$").isNotNull(), t).when(F.get_json_object(quoted, "$").isNotNull(), quoted)

    def braces(t: Column) -> Column:
        return F.char_length(t) - F.char_length(F.replace(t, F.lit("{")))

    bare = F.trim(text)
    whole = parsed(F.when(bare.startswith("{") & bare.endswith("}"), bare))
    whole = F.when(braces(F.get_json_object(whole, "$")) == braces(whole), whole)  # the parser reads the first of several
    runs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\{.*?\}"), F.lit(0)), parsed), lambda t: t.isNotNull())
    keyed = F.filter(runs, lambda t: reduce(or_, [F.get_json_object(t, f"$.{k}").isNotNull() for k in keys], F.lit(False)))
    return F.coalesce(whole, F.get(keyed, F.size(keyed) - 1), F.get(runs, F.size(runs) - 1))


def descriptions(text: Column, key: str = "frame_descriptions") -> Column:
    """Array of (segment_id, description) that a response lists; empty where it lists none."""
    listed = F.get_json_object(response_object(text, *REPLY_KEYS), f"$.{key}")
    return F.coalesce(F.from_json(listed, "array<struct<segment_id:string,description:string>>"), F.array().cast("array<struct<segment_id:string,description:string>>"))


def answer_index(text: Column, key: str = "final_answer") -> Column:
    """0-4 (or -1) from an object's answer: the number itself, a letter A-E, or a digit 0-4 that stands alone; null where there is none."""
    said = F.upper(F.trim(F.get_json_object(response_object(text, *REPLY_KEYS), f"$.{key}")))
    by_letter = F.when(said.rlike("^[A-E]$"), F.ascii(said) - 65)
    inside = _nonempty(F.regexp_extract(said, rf"(?:^|{EDGE})([0-4])(?:$|{EDGE})", 1)).try_cast("int")
    return F.coalesce(F.when(said.rlike("^(-1|[0-4])$"), said.try_cast("int")), by_letter, inside)


def answer_or_draw(text: Column, seed: int | str, *keys: Column, key: str = "final_answer") -> Column:
    """answer_index; an answer out of range is drawn from 0-4 by seed and keys, and a text without an object that has one is -1."""
    drawn = F.floor(draws.uniform(seed, *keys) * 5).cast("int")
    said = F.get_json_object(response_object(text, *REPLY_KEYS), f"$.{key}")
    return F.when(said.isNull(), F.lit(-1)).otherwise(F.coalesce(answer_index(text, key), drawn))


def confidence(text: Column, seed: int | str, *keys: Column, key: str = "confidence") -> Column:
    """1-3 from an object's confidence; a whole number out of range is drawn by seed and keys, and where there is none it is 1."""
    said = F.get_json_object(response_object(text, *REPLY_KEYS), f"$.{key}").try_cast("double").try_cast("bigint")
    drawn = F.floor(draws.uniform(seed, *keys) * 3).cast("int") + 1
    return F.when(said.isNull(), F.lit(1)).when(said.between(1, 3), said.cast("int")).otherwise(drawn)
