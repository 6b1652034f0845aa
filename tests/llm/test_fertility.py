import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ironsieve.llm import fertility
from ironsieve.llm.fertility import FOLDER, SYMBOLS, VOCABULARIES, Lexicon, fertility_rules, measure, script_of_word, vocabulary
from ironsieve.session import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILES = [(f"{FOLDER}/{v}", open(f"{FOLDER}/{v}", "rb").read()) for v in VOCABULARIES]


@pytest.fixture(scope="module")
def kinds():
    return [vocabulary(*f) for f in FILES]


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(again)


def measures(text, kinds):
    out, words = [], WORD.findall(text or "")
    for kind in kinds:
        tokens = [t for w in words for i in range(0, len(w), 4096) for t in kind([w[i : i + 4096]])[0]]
        n, count = len(tokens), Counter(tokens)
        entropy = -sum(c / n * math.log2(c / n) for c in count.values())
        out += [sum(map(len, words)) / max(1, n), sum(bool(kind.byte[t]) for t in tokens) / max(1, n), entropy]
    return out


def some_texts():
    r = random.Random(1)
    words = ["the", "tion", "über", "слово", "日本語", "a#b", "*", "\x1c", "é́", "<p>", "x" * 50, "\U0001f600", " "]
    texts = [None, "", "   \n", "one", "퟿ ok", "a b c d e a b c d e", "l 1\nl 1\n \n \nl 1", "w " * 4000, "y" * 9000 + " " + "z" * 5000, "\t\x0b\x0c\r x"]
    return texts + [r.choice([" ", "\n"]).join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(150)]


def test_counts_and_measures_against_plain_python(kinds):
    texts = some_texts()
    for step in (1, 7, 200):
        lexicon, at = Lexicon(kinds), 0
        while at < len(texts):
            part = texts[at : at + step]
            got = measure(part, lexicon)
            for i, text in enumerate(part):
                assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(text)
                assert np.allclose(got["measures"][i], measures(text, kinds))
            at += step


def test_words_are_forgotten_and_found_again(kinds, monkeypatch):
    monkeypatch.setattr(fertility, "KNOWN", 5)
    lexicon = Lexicon(kinds)
    for k in range(4):
        texts = [f"w{k} a b c d e f g {'long' * 3000} w{k} a b c d", "a " * 300_000]
        got = measure(texts, lexicon)
        assert [int(x) for x in got["n_repeat_words"]] == [base(t)[4] for t in texts]
        assert np.allclose(got["measures"][0], measures(texts[0], kinds))


def test_scripts():
    assert [script_of_word(w) for w in ("1a", "Ωm", "слово", "日本", "--", "über")] == ["LATIN", "GREEK", "CYRILLIC", "CJK", None, "LATIN"]


def _bin(m, x):
    return math.floor((math.log2(max(x, 2**-10)) if m == 0 else x) * fertility.BINS[m])


def brute(rows, kinds, least):
    """{id: kept} by sorted lists."""
    facts = {}
    for i, lang, text in rows:
        b = base(text)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        m = [_bin(k % 3, x) for k, x in enumerate(measures(text, kinds))]
        letters = Counter(s for s in map(script_of_word, WORD.findall(text or "")) if s)
        script = min(letters, key=lambda s: (-letters[s], s)) if letters else "none"
        tokens = sum(len(kinds[0]([w])[0]) for w in WORD.findall(text or ""))
        facts[i] = (b, failed, m, f"language {lang}" if lang is not None else f"script {script}", int(math.log2(max(1, tokens))))
    good = [f for f in facts.values() if not f[1]]

    def band(some, k, of_length):
        x = sorted(f[2][k] for f in some)
        q1, q2, q3 = (x[-(-len(x) * q // 4) - 1] for q in (1, 2, 3))
        if k % 3 == 2 and not of_length:
            return -math.inf, math.inf
        return q2 - max(fertility.REACH * (q2 - q1), fertility.LEAST_BELOW[k % 3]), q2 + max(fertility.REACH * (q3 - q2), fertility.LEAST_ABOVE[k % 3])

    out = {}
    for i, (b, failed, m, kind, length) in facts.items():
        groups = [[f for f in good if f[3:] == (kind, length)], [f for f in good if f[3] == kind], good]
        group = next((g for g in groups if len(g) >= least), None)
        off = [not (band(group, k, group is groups[0])[0] <= m[k] <= band(group, k, group is groups[0])[1]) for k in range(6)] if group and not failed else [False] * 6
        out[i] = (*b, failed, not failed and not any(off[k] and off[k + 3] for k in range(3)))
    return out


def test_verdicts_against_brute_force(spark, kinds):
    r = random.Random(3)
    syllables = ["the", "ta", "on", "er", "li", "schen", "que", "ou"]
    rows = []
    for i in range(260):
        n = r.choice([5, 12, 30, 40, 80])
        rows.append((i, r.choice(["en", "en", "de", None]), " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))))
    rows += [(1000 + i, "en", " ".join("".join(r.choice("0123456789abcdef+/=") for _ in range(40)) for _ in range(30))) for i in range(3)]
    rows += [(1010, "en", " ".join("".join(chr(r.randrange(0x1F000, 0x1FAFF)) for _ in range(5)) for _ in range(40))), (1011, "xx", " ".join(f"слово{k}" for k in range(50)))]
    rows += [(2000, None, None), (2001, "en", ""), (2002, "zz", "a b"), (2003, "en", "12 34 56 78 90 12 33 44 55 66 77")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, lang string, text string, kind string, bins int").repartition(3)
    got = {x.doc_id: tuple(x[1:8]) for x in fertility_rules(df, least=20).collect()}
    want = brute(rows, kinds, 20)
    assert got == want
    assert not any(want[i][-1] for i in (1000, 1001, 1002, 1010)) and sum(x[-1] for x in want.values()) > 180
    assert fertility_rules(df.limit(0)).collect() == []
    assert all(x.kept != x.base_failed for x in fertility_rules(df, least=10_000).collect())


def test_clean_documents_stay(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    good = read_table(spark, "/root/testdata/sf0.01", "labels").where("quality = 1").select("doc_id")
    rows = fertility_rules(docs).join(good, "doc_id").collect()
    assert len(rows) > 50 and sum(not x.kept and not x.base_failed for x in rows) == 0
