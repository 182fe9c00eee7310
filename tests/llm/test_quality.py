from __future__ import annotations

import random
import time
from collections import Counter

from llm.conftest import WORD, odd_rows

from viewgrain.llm import quality


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {k + j for k in range(len(words) - 2) if windows[words[k], words[k + 1], words[k + 2]] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed


def measures(df):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return Counter((r.doc_id, *(r[n] for n in names)) for r in quality.judged(df).collect())


def test_measures_against_brute_force(session, odd, none):
    assert measures(odd) == Counter((r[0], *brute(r[1])) for r in odd_rows())
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "a", "# ", "\t", "é "]) for _ in range(rng.randint(0, 200)))) for i in range(150)]
    assert measures(session.createDataFrame(rows, "doc_id long, text string")) == Counter((i, *brute(t)) for i, t in rows)
    assert quality.judged(none).count() == 0


def test_lines_and_rejections(session):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(6))
    menu = "Home | News | Sport | Contact us"
    rows = [
        (1, prose),
        (2, menu + "\n" + prose + "\n\nAll rights reserved."),
        (3, prose + "\n" + "\n".join("Buy*** now### cheap$$$ pills%%% today&&&" for _ in range(40))),
        (4, "\n".join([menu] * 60)),
        (5, "too short."),
    ]
    docs = session.createDataFrame([(*r, 9, "en") for r in rows], "doc_id long, text string, n_chars long, n_words string")
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: r for r in kept.collect()}
    assert set(got) == {1, 2}
    assert got[1].text == prose and got[2].text == prose + "\n" and got[2].n_chars == len(prose) + 1


def test_no_python_in_the_plan(odd, capsys):
    quality.cleaned(odd).explain()
    assert "Python" not in capsys.readouterr().out


def test_many_failing_lines_take_linear_time(session):
    prose = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(8000))
    text = prose + "\n" + "\n".join(f"*** {i} ***" for i in range(50_000))
    docs = session.createDataFrame([(1, text), (2, "\n".join(f"## {i}" for i in range(200_000)))], "doc_id long, text string")
    began = time.monotonic()
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[1].kept and got[1].clean_text == prose and not got[2].kept
    assert time.monotonic() - began < 60
