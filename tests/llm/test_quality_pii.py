import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import pii, quality


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@pytest.mark.parametrize("seed", range(40))
def test_statistics(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["a", "b", "c", " ", "\n", "\t", "\x0b", "é#", "\x85", " a b c ", "|"]) for _ in range(rng.randint(0, 60)))
    assert quality.text_statistics(text) == brute_statistics(text)


def test_judge(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(300)]
    bad = [(1000 + i, " ".join(word() + rng.choice(["###", "&&&", ""]) for _ in range(80))) for i in range(60)]
    extra = [(2000, None), (2001, ""), (2002, "x y z " * 100), good[0]]
    docs = spark.createDataFrame(good + bad + extra, "doc_id long, text string").withColumn("n_words2", F.lit(1))
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:40]] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.judge(docs, labels).collect()}
    assert sum(out[i].kept for i, _ in good) >= 297 and sum(out[i].kept for i, _ in bad) <= 2
    assert [out[i].base_failed for i in (2000, 2001, 2002)] == [True] * 3 and not out[2002].kept
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(t or "") for (i, t) in good[:20] + extra if (r := out[i]))
    bare = quality.judge(docs, labels.filter("quality = 1")).filter("kept").count()
    assert bare == len(good) + len(bad) + 1  # without both kinds only the base rule rejects
    assert quality.judge(docs, labels, keep_text=True).columns[: len(docs.columns)] == docs.columns
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_path_lengths():
    rng = np.random.default_rng(0)
    forest = quality.grow(rng.normal(size=(500, 2)))
    scores = forest.score(np.array([[0.0, 0.0], [9.0, 9.0]]))
    assert scores[1] > scores[0] + 0.1


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans():
    rng = random.Random(3)
    parts = ["1", "2", "255", "256", "0", ".", "@", "a", "b-", "-", " ", "+", "(", ")", "%", "4111111111111111", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "\n", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        assert pii.base_spans(t) == brute_spans(t)


def test_patterns_are_linear():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        pii.base_spans(t)


def test_field_labels_held_out_examples():
    model = pii.train()
    found = lambda t: pii.find_spans([t], model)[0]
    base, every = found("ring +1 (415) 555-0199 4111111111111111 now")
    assert base == [] and every == [("card", 23, 39), ("phone", 5, 22)]
    held = {"call (617) 555-0123 today": 1, "mail kim[at]example.org soon": 1, "in 2015 we saw 12 birds": 0, "it was 45% of 900": 0, "see page 17 of 30": 0, "nothing here": 0}
    assert [len(found(t)[1]) for t in held] == list(held.values())
    runs = pii.labelled_runs()
    assert [len(f) for f, _ in runs] == [len(y) for _, y in runs]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    n = len(pii.LABELS)
    model = pii.Field(np.zeros((1, n)), rng.normal(size=(n, n)))
    x = rng.normal(size=(3, n))
    best = max(((a, b, c) for a in range(n) for b in range(n) for c in range(n)), key=lambda p: model.move[0, p[0]] + x[0, p[0]] + model.move[p[0], p[1]] + x[1, p[1]] + model.move[p[1], p[2]] + x[2, p[2]] + model.move[p[2], 0])
    assert model.decode([x])[0] == list(best)


def test_spans_of(spark):
    rows = [(1, "me@x.org and 10.0.0.1"), (2, None), (3, ""), (1, "me@x.org and 10.0.0.1"), (4, "word " * 50_000 + "me@x.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    out = pii.spans_of(docs, mask="<{kind}>").collect()
    got = {(r.doc_id, r.text[-30:] if r.text else r.text) for r in out}
    assert (1, "<email> and <ip>") in got and (2, None) in got and (3, "") in got and len(out) == 5
    assert next(r for r in out if r.doc_id == 4).text.endswith("<email>")
    assert pii.spans_of(docs.limit(0)).count() == 0
