import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from framesift.functions import answers
from framesift.operators import agent

MODEL = "m1"


class Plain:
    """The loop for one sample, call by call; records every call it makes."""

    def __init__(self, replies):
        self.replies, self.calls = replies, {}

    def ask(self, step, prompt):
        key = hashlib.md5("\n".join([MODEL, agent.SYSTEM, prompt]).encode()).hexdigest()
        self.calls[key] = reply = self.replies(step, key)
        return reply

    def run(self, question, captions, scores, budget):
        n, rounds = len(captions), []
        chosen = sorted({int(1 + i * (n - 1) / 4) for i in range(5)})
        for i in (1, 2, 3):
            asked = f"A video has {n} captioned frames. Some of them:\n" + "\n".join(f"frame {c}: {captions[c - 1]}" for c in chosen)
            asked += f'\nQuestion: {question}\nReply with the index of the best answer: {{"final_answer": index}}'
            said = self.ask("answer", asked)
            answer, sure = json.loads(said)["final_answer"], None
            if i < 3:
                rated = self.ask("confidence", asked + f'\nThe answer was: {said}\nRate how far the captions support it (1 hardly, 2 partly, 3 fully): {{"confidence": rating}}')
                sure = json.loads(rated)["confidence"]
            rounds.append((i, list(chosen), answer, sure))
            if i == 3 or sure == 3:
                break
            listed = ", ".join(f"{k + 1}: {a}-{b}" for k, (a, b) in enumerate(zip(chosen, chosen[1:], strict=False)))
            said = self.ask("describe", asked + f'\nThese captions are not enough. Segments between them: {listed}\nName those worth a look: {{"frame_descriptions": [{{"segment_id": number, "description": text}}]}}')
            more = set()
            for d in json.loads(said)["frame_descriptions"]:
                k = int(d["segment_id"])
                if 1 <= k < len(chosen):
                    inside = [c for c in range(chosen[k - 1] + 1, chosen[k])]
                    if inside:
                        more.add(max(inside, key=lambda c: (scores[c - 1], -c)))
            chosen = sorted(set(chosen) | more)
        m = len(chosen)
        picked = chosen if m <= budget else [chosen[int(i * ((m - 1) / (budget - 1)))] if i < budget - 1 else chosen[-1] for i in range(budget)]
        return rounds, picked


def replies(step, key):
    a, b = int(key[:2], 16), int(key[2:4], 16)
    return {"answer": json.dumps({"final_answer": a % 5}), "confidence": json.dumps({"confidence": a % 3 + 1}), "describe": json.dumps({"frame_descriptions": [{"segment_id": a % 5, "description": "it's {here}"}, {"segment_id": str(b % 7)}]})}[step]


def tables(spark, videos):
    samples = spark.createDataFrame([(k, q, c) for k, (q, c, _) in videos.items()], "sample long, question string, captions array<string>")
    scores = spark.createDataFrame([(k, i + 1, x) for k, (_, _, s) in videos.items() for i, x in enumerate(s)], "sample long, idx int, score double")
    return samples, scores


def test_rounds_equal_a_plain_loop_and_decided_samples_are_not_asked_again(spark):
    videos = {k: (f"why {k}?", [f"caption {k} {i}" for i in range(2 + k % 23)], [(i * 7919 * (k + 1)) % 11 / 10 for i in range(2 + k % 23)]) for k in range(40)}
    plain = Plain(replies)
    want = {k: plain.run(*v, budget=6) for k, v in videos.items()}
    recorded = spark.createDataFrame([(k, r) for k, r in plain.calls.items()], "call_key string, response string")
    asked = []

    def ask(calls):
        asked.append({(r["sample"], r["step"]) for r in calls.select("sample", "step").collect()})
        return agent.replayed(recorded)(calls)

    samples, scores = tables(spark, videos)
    found = agent.agent_rounds(samples, scores, ask, model=MODEL).collect()
    assert sorted((r["sample"], r["round"], r["chosen"], r["answer"], r["confidence"]) for r in found) == sorted((k, *r) for k, (rounds, _) in want.items() for r in rounds)
    sizes = [len({s for s, _ in calls}) for calls in asked]
    assert sizes == [40, 40] + [sum(len(r) >= 2 for r, _ in want.values())] * 3 + [sum(len(r) >= 3 for r, _ in want.values())] * 2
    picked = agent.pick_agent(samples, scores, agent.replayed(recorded), 6, model=MODEL).collect()
    assert {r["sample"]: (r["rounds"], r["answer"], r["chosen"]) for r in picked} == {k: (len(rounds), rounds[-1][2], chosen) for k, (rounds, chosen) in want.items()}


def test_missing_responses_and_odd_samples(spark):
    samples = spark.createDataFrame([(1, None, ["a", None, "c"]), (2, "q", ["only one"]), (3, "q", None), (4, "q", [])], "sample long, question string, captions array<string>")
    scores = spark.createDataFrame([(1, 2, None)], "sample long, idx int, score double")
    nothing = spark.createDataFrame([], "call_key string, response string")
    found = agent.agent_rounds(samples, scores, agent.replayed(nothing), model=MODEL).collect()
    assert [(r["sample"], r["round"], r["chosen"], r["answer"]) for r in sorted(found, key=lambda r: r["round"])] == [(1, i, [1, 2, 3], -1) for i in (1, 2, 3)]
    assert agent.pick_agent(samples.limit(0), scores, agent.replayed(nothing), 2, model=MODEL).collect() == []
    one = agent.pick_agent(samples, scores, agent.replayed(nothing), 1, model=MODEL).head()
    assert one["chosen"] == [1]
    with pytest.raises(ValueError):
        agent.pick_agent(samples, scores, agent.replayed(nothing), 0, model=MODEL)


def first_object(text):
    """What the response's object is, by json.loads."""

    def load(t):
        for form in (t, t.replace("'", '"')):
            try:
                return json.loads(form)
            except ValueError:
                pass

    whole = load(text)
    if isinstance(whole, dict):
        return whole
    runs = [x for x in map(load, re.findall(r"\{[\s\S]*?\}", text)) if isinstance(x, dict)]
    keyed = [x for x in runs if "final_answer" in x or "confidence" in x]
    return (keyed or runs or [None])[-1]


def test_objects_in_responses(spark):
    nested = json.dumps({"frame_descriptions": [{"segment_id": "2", "description": "a {b}"}, {"segment_id": 3}], "confidence": 2})
    texts = [nested, f"so: {nested} done", '{"confidence": 1} {"final_answer": 2}', '{"final_answer": 1} then {"confidence": 3}', '{"x": 1} {"y": 2}', "{'final_answer': 'c'}", " {\n 'confidence': 2 }\n", "{broken {\"final_answer\": 4} x", "{}", "none", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", answers.response_object(F.col("t"), "final_answer", "confidence").alias("o"), answers.descriptions(F.col("t")).alias("d")).orderBy("i").collect()
    for r, text in zip(found, texts, strict=True):
        want = first_object(text)
        assert (json.loads(r["o"].replace("'", '"')) if r["o"] else None) == want, text
    assert [(d["segment_id"], d["description"]) for d in found[0]["d"]] == [("2", "a {b}"), ("3", None)] and all(r["d"] == [] for r in found[1:])
