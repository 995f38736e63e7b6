"""Spam pages and pages that only look like them."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import spam
from loomgrid.llm.automata import Automata
from loomgrid.llm.spam import spam_pages, spam_share, spam_shares

PROSE = "The report was sent back since the vendor restated the volumes, so the ratio for this factor is short-lived. It took ten attempts until the sampler returned something other than a rank of average volume. "
SPAM = [
    "stock picks / stock picks / rank IC / price panel / " * 12,
    "factor zoo here, best factor zoo, more factor zoo! Order factor zoo now: factor zoo for all. Looking for factor zoo? We have factor zoo, cheap factor zoo and factor zoo today. " * 5,
    "\n".join(f"best factor Name{chr(97 + i)} signal feed Other{chr(97 + i)} best factor signal feed" for i in range(20)),
    "\n".join(f"[cheap data {i}](https://shop{i}.example/item/{i})" for i in range(20)),
    " ".join(f"www.shop{i}.test/tag/{i}" for i in range(20)),
    " ".join(f"#momentum_list{i} #dailypicks" for i in range(20)),
    " ".join(f"0677576{i % 10}.SS buy ZQTXAZ{chr(65 + i)} quote" for i in range(20)),
    "\n".join(f"Name{chr(97 + i)} rank IC / in stock ${i}5" for i in range(20)),
    "tags: " + " ".join("signal stock-tre signal-yor price index signals low momentum volume free stock price".split() * 4),
]
FINE = [
    PROSE * 3,
    "date | asset | close | volume\n" + "\n".join(f"2020-01-{i:02d} | ZQTXAZV | {i}.25 | {i}00" for i in range(1, 29)),
    "def factor(df):\n" + "\n".join(f'    a{i} = df["low"].rolling(window={i}).mean()' for i in range(20)) + "\n    return a0\n",
    "\n".join(f"- The term number {i} is the average of the closing prices that were seen in the window of the panel." for i in range(9)),
    PROSE * 4 + " ".join(f"www.shop{i}.test/tag/{i}" for i in range(5)),
    "THE TEAM BEHIND THIS BOOK SPLITS A PORTFOLIO OF NAMES GIVEN A FEE OF POINTS AT THE MARKET. STATE THE SIGN OF THE SPREAD AND ITS BOUND. " * 2,
    "Sur le marché, la rotation baisse, parce que les volumes ont été révisés. Sur le marché, le rang monte, parce que les volumes ont été révisés. " * 4,
    "stock picks stock picks",
]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam_share(text)[1] > 0.5
    assert spam_share(PROSE * 9 + "\n" + text[:300])[1] < 0.5  # a smaller part of a page


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert spam_share(text)[1] <= 0.5


def test_operator_handles_nulls_empty_and_very_long_texts(spark):
    rows = [(1, None, 2, "a"), (2, "", 3, "b"), (3, SPAM[0], 1, "c"), (3, SPAM[0], 1, "c"), (None, SPAM[3], 1, "d"), (4, PROSE * 3000, 1, "e"), (5, SPAM[0] * 500, 1, "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, i string")
    assert sorted((str(r.doc_id) for r in spam_pages(df, "doc_id", "text").collect())) == ["3", "3", "5", "None"]
    assert spam_pages(df.limit(0), "doc_id", "text").collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=4), st.integers(2, 7))
def test_automata_count_substrings_like_a_plain_count(sequences, times):
    a = Automata(np.array([x for q in sequences for x in q], dtype=np.uint64), np.array([i for i, q in enumerate(sequences) for _ in q], dtype=np.int64))
    longest, at = a.longest(times), 0
    for q in sequences:
        count = Counter(tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1))
        for e in range(len(q)):
            assert longest[at + e] == max((n for n in range(1, e + 2) if count[tuple(q[e - n + 1 : e + 1])] >= times), default=0)
            for n in (1, 2, 3, 5):
                assert a.occurrences(n)[at + e] == (count[tuple(q[e - n + 1 : e + 1])] if n <= e + 1 else 0)
        at += len(q)


def test_automata_of_nothing_and_of_long_repeats():
    assert Automata(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)).longest(2).tolist() == []
    a = Automata(np.array([7, 8, 9] * 500, dtype=np.uint64), np.zeros(1500, dtype=np.int64))
    assert a.longest(2)[-1] == 1497 and a.longest(500)[-1] == 3 and a.covered(2).all()


def test_every_page_has_its_automaton(monkeypatch):
    seen = []
    monkeypatch.setattr(spam, "Automata", lambda symbols, owner: seen.append(set(owner.tolist())) or Automata(symbols, owner))
    pages = [*SPAM, *FINE, PROSE, "a " * 30]
    spam_shares(pages)
    assert set.union(*seen) >= set(range(len(pages)))


def test_one_long_keyword_in_short_sentences():
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    stuffed = " ".join(f"{name(7 * i)} of {name(i)} scannerportfolio {name(3 * i)} {name(5 * i)}." for i in range(33))
    article = " ".join(f"the {name(i + 2000)} was {name(i + 900)}." for i in range(39))
    n, share = spam_share(f"{stuffed} {article}")
    assert n == 354 and share == pytest.approx(33 * 6 / 354)


def test_pages_do_not_change_each_other():
    pages = [*SPAM, *FINE, None, "", *SPAM[::-1]]
    n_words, share = spam_shares(pages)
    assert [(int(n), float(s)) for n, s in zip(n_words, share)] == [spam_share(p) for p in pages]


def test_many_small_keywords_in_short_sentences():
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    keys = [f"best {name(i)}er {name(7 * i)}zoo" for i in range(25)]
    page = " ".join(f"Get {keys[i % 25]} x{name(i)} y{name(i)}." for i in range(500))  # each 2 % of the words, half of them together
    assert spam_share(page)[1] > 0.9


def test_one_sentence_repeated():
    assert spam_share("The best stock screener for factor investors is available on our site today. " * 50)[1] > 0.9


def test_little_stuffing_beside_links():
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    links = " ".join(f"www.a{name(i)}.test/b{name(i)}" for i in range(105))  # 4 words each
    article = " ".join(f"the {name(i)} was {name(i + 900)}." for i in range(110))
    key = "indicator portfolio analytics benchmark"
    stuffed = " ".join(f"the {key} of " + " ".join(f"{name(i * 9 + k + 3000)}" for k in range(8)) + "." for i in range(10))
    n, share = spam_share(f"{links}\n{article}\n{stuffed}")
    assert n == 1000 and share == pytest.approx(0.56)


def test_share_is_whole_above_the_threshold(spark):
    page = " ".join(f"www.shop{i}.test/tag/{i}" for i in range(20)) + "\n" + SPAM[0]
    assert spam_share(page)[1] == 1.0
    assert spam_pages(spark.createDataFrame([(1, page)], "doc_id bigint, text string"), "doc_id", "text", 0.9).count() == 1
