from __future__ import annotations

import random
import re
from collections import Counter

from recollect.llm import quality
from tests.llm.helpers import clashing, odd_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if grams[tuple(w[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed


def test_counts_match_plain_python(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(150):
        few = [rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.choice([3, 8, 60]))]
        texts.append("".join(rng.choice(few) + rng.choice([" ", "\n", "\t ", "\x0b", " \u00a0", "|", ".\n"]) for _ in range(rng.randrange(0, 120))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in quality.quality(df).collect():
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == plain(texts[r["doc_id"]]), texts[r["doc_id"]]


def prose(k, n=12):
    rng = random.Random(k)
    return "\n".join(" ".join(f"word{rng.randrange(10_000)}" for _ in range(n)) + "." for _ in range(8))


def test_lines_go_and_documents_that_lose_too_much(spark):
    menu, shout = "Home | News | Sport | Weather", "BUY IT NOW OR NEVER AND BE GLAD OF IT!"
    texts = [
        prose(1), prose(2) + f"\n{menu}\nAll rights reserved.\n{shout}", "\n".join([prose(3, 7)] + [f"{menu} | {k} | {prose(k, 4)[:60]}" for k in range(20)]),
        prose(4).replace(".", ""), prose(5) + "\n" + prose(5).split("\n")[0],
    ]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert [got[k]["kept"] for k in range(5)] == [True, True, False, False, True]
    assert got[1]["cleaned"] == prose(2) and got[4]["cleaned"] == prose(5)


def test_no_python_and_no_shuffle(spark):
    plan = quality.quality(odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_odd_rows(spark):
    docs = clashing(odd_docs(spark), ["n_words", "kept", "cleaned", "base_failed"])
    got = quality.quality(docs).collect()
    assert len(got) == 10
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain(r["text"])
    assert quality.quality(docs.limit(0)).count() == 0


def test_clean_prose_of_all_scripts_is_kept(spark):
    """End marks of other scripts, quotations, dots inside words, and long lines without a mark."""
    rng = random.Random(9)
    words = lambda n, size=8: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, size))) for _ in range(n))
    body = words(185)
    quoted = body.split()
    for k in (20, 60, 100):
        quoted[k] = "« " + quoted[k] + " »"
    dotted = body.split()
    for k in (10, 50, 90, 120):
        dotted[k] = "il·lusió"
    short = lambda mark: "\n".join(words(12) + mark for _ in range(8))
    texts = [body + "“", body + " »", body + "।", body + "؟", " ".join(quoted) + ".", " ".join(dotted) + ".", body,
             *[short(m) for m in ("“", " »", "।", "؟", "۔", "」", "！", "។", "]")]]
    bad = [short(""), short(","), "\n".join(["Home · News · Sport · Weather."] * 1 + [f"{words(2)} » {words(2)} » {words(2)} » {words(2)}." for _ in range(12)])]
    df = spark.createDataFrame(list(enumerate(texts + bad)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(df).collect()}
    assert [got[k] for k in range(len(got))] == [True] * len(texts) + [False] * len(bad)
