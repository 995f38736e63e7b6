"""Keyword-stuffed, link-list and tag-list pages, by suffix automata and clause structure."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.automata import Automata, marked

#: Pages with fewer words are too short to judge.
LEAST_WORDS = 20
#: Share of a page's words that makes it spam.
SPAM_SHARE = 0.5
#: A keyword or stock phrase occurs so often; a large keyword has at most so many words and alone so large a share of the page's words.
KEY_TIMES, KEY_WORDS, KEY_SHARE = 6, 4, 0.05
#: Least share of the page's words under all repeated phrases together.
JOINT_SHARE = 0.05
#: Share of a segment's characters under keywords from which the segment is stuffed.
STUFFED = 0.4
#: Segments filled by phrases: share of characters under them from which they count, and the most clause words among all such segments.
FILLED = ((STUFFED, 1 / 6), (0.9, 1 / 3))
#: Share of a list's characters under repeats from which clauseless lines are a list, and its least lines or words.
LISTED, LIST_LINES, LIST_WORDS = 0.4, 5, 12
#: Share of clause words from which a segment is built of clauses.
CLAUSE = 0.15
#: Least tickers of a run of tickers, and their share of its tokens.
TICKERS, TICKER_SHARE = 5, 0.4
#: Characters of whole pages whose automata are built at a time; a longer page is taken alone.
SLICE_CHARS = 1_000_000

#: Words that carry the clauses of English, German, French and Spanish.
CLAUSE_WORDS = frozenset(
    """a an and are as at be but by for from had has have if in into is it its not of on or since so than that the then there this to was were when which while who why with would
    am auf aus bei das dem den der des die durch ein eine einem einen einer ist im in mit nach nicht oder und vom von war waren weil wird zu zum zur über um als
    au aux avec ce ces dans de des donc du elle en est et il la le les mais ne ont ou par parce pas pour que qui sa ses son sur un une était
    al con como cuando del desde el ella en entre era es esta este fue ha las los más no para pero por porque se según si sin su una y ya""".split()
)
#: Words that open a statement of code.
CODE_WORDS = frozenset("def return import from class".split())

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\")\]]+|(?<![\w@.])[\w-]+(?:\.[\w-]+)+/[^\s<>\")\]]*", re.I)
_ANCHOR = re.compile(r"\[[^\[\]\n]*\]\(\s*[^()\s]+\s*\)|<a\b[^<>]*>.*?</a\s*>", re.I | re.S)
_MARKUP = re.compile(r"</?[a-z][^<>\n]*>", re.I)
_TICKER = re.compile(r"^\W*(?:\d{4,8}\.[A-Z]{1,3}|[A-Z]{5,}(?:\.[A-Z]{1,2})?|\$[A-Z]{2,})\W*$")

ALNUM, SPACE, DIGIT, UPPER, LETTER, WORD, BRACKET, MONEY = (1 << k for k in range(8))
BODY, LINK, TAG = 0, 1, 2
_BASE = 0x9E3779B97F4A7C15
#: Symbols of the automata that stand for a whole link, tag or ticker.
_LINKS, _TAGS, _TICKERS = (np.uint64(0xA5A5A5A5_00000001 + k) for k in range(3))


class _Characters:
    """Classes and lower case of characters; those beyond the first thousands are looked up when they first occur."""

    def __init__(self) -> None:
        self.classes = np.zeros(0x110000, dtype=np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.known = 0
        self._learn(range(0x2500))
        self.known = 0x2500
        self.later: set[int] = set()

    def _learn(self, codes: Sequence[int]) -> None:
        for c in codes:
            x = chr(c)
            self.classes[c] = ALNUM * x.isalnum() | SPACE * x.isspace() | DIGIT * x.isdecimal() | UPPER * ("A" <= x <= "Z") | LETTER * x.isalpha() | WORD * (x.isalnum() or x == "_") | BRACKET * (x in "=(){}[]") | MONEY * (x in "$€£")
            if len(x.lower()) == 1:
                self.lower[c] = ord(x.lower())

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(codes) and int(codes.max()) >= self.known:
            new = set(np.unique(codes[codes >= self.known]).tolist()) - self.later
            self._learn(sorted(new))
            self.later |= new
        return self.classes[codes], self.lower[codes]


_CHARACTERS: list[_Characters] = []
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 2**64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, dtype=np.uint64)]) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _count(mask: np.ndarray) -> np.ndarray:
    """Prefix counts: how many are set before each position; one longer than the mask."""
    out = np.zeros(len(mask) + 1, dtype=np.int32)
    np.cumsum(mask, out=out[1:])
    return out


def _runs(mask: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First position and end of the runs of set positions; ``cut`` marks positions that begin a run of their own."""
    before, after = np.r_[False, mask[:-1]], np.r_[mask[1:], False]
    if cut is None:
        return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return np.flatnonzero(mask & (~before | cut)), np.flatnonzero(mask & (~after | np.r_[cut[1:], True])) + 1


def _hashes(lower: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit codes of the words from first to end."""
    n = len(lower)
    power, inverse = _powers(max(n, 1))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        code = (total[end] - total[first]) * inverse[first]
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return code ^ (code >> np.uint64(32))


def _codes_of(words: Sequence[str]) -> np.ndarray:
    text = " ".join(sorted(words))
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    first, end = _runs(codes != 32)
    return np.sort(_hashes(codes, first, end))


_WORD_SETS: list[np.ndarray] = []


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return known[at] == codes


def _kinds(joined: str, starts: np.ndarray, codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each character belongs to (page, link or tag), and where links and tags begin."""
    kind = np.zeros(len(codes), dtype=np.uint8)
    begins: list[int] = []

    def mark(first: int, end: int) -> None:
        kind[first:end] = LINK
        begins.append(first)

    odd = np.flatnonzero((codes == ord("[")) | (codes == ord("<")))
    for page in np.unique(np.searchsorted(starts, odd, "right") - 1):
        low, high = int(starts[page]), int(starts[page + 1])
        text = joined[low:high]
        for pattern, sign in ((_ANCHOR, "](" if "](" in text else "<"), (_MARKUP, "<")):
            if sign in text:
                found = [m.span() for m in pattern.finditer(text)]
                for first, end in found:
                    mark(low + first, low + end)
                    text = text[:first] + " " * (end - first) + text[end:] if len(found) < 3 else text
                if len(found) >= 3:
                    text = pattern.sub(lambda m: " " * len(m.group()), text)
    body = kind == BODY
    slash, dot = body & (codes == ord("/")), body & ((codes == ord(".")) | (codes == ord(":")))
    first, end = _runs(body & (classes & SPACE == 0))
    slashes, dots = _count(slash), _count(dot)
    w = (codes | 32) == ord("w")
    www = np.flatnonzero(w[:-3] & w[1:-2] & w[2:-1] & (codes[3:] == ord("."))) if len(codes) > 3 else np.zeros(0, dtype=np.int64)
    likely = (slashes[end] > slashes[first]) & (dots[end] > dots[first])
    likely[np.searchsorted(first, www, "right") - 1] |= True
    for a, b in zip(first[likely].tolist(), end[likely].tolist()):
        for m in _URL.finditer(joined[a:b]):
            mark(a + m.start(), a + m.end())
    at = np.flatnonzero((codes == ord("#")) & (kind == BODY))
    if len(at):
        name = (classes & WORD != 0) & (kind == BODY)
        at = at[~np.r_[False, name][at] & np.r_[name, False][at + 1]]
        _, stops = _runs(name)
        for a, b in zip(at.tolist(), stops[np.searchsorted(stops, at + 1)].tolist() if len(at) else []):
            kind[a:b] = TAG
            begins.append(a)
    return kind, np.array(sorted(begins), dtype=np.int64)


def _per(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(index, weights, minlength=n)


def _measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words and spam words of each page."""
    pages = len(texts)
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not _CHARACTERS:
        _CHARACTERS.append(_Characters())
        _WORD_SETS[:] = [_codes_of(CLAUSE_WORDS), _codes_of(CODE_WORDS), _codes_of(["select"])]
    classes, lower = _CHARACTERS[0].of(codes)
    starts = np.cumsum(np.r_[0, [len(t) + 1 for t in texts]])
    kind, items = _kinds(joined, starts, codes, classes)

    # words
    alnum = classes & ALNUM != 0
    first, end = _runs(alnum, np.r_[True, kind[1:] != kind[:-1]])
    n = len(first)
    page = np.searchsorted(starts, first, "right") - 1
    total = _per(page, pages)
    size = end - first
    code = _hashes(lower, first, end)
    what = kind[first]
    body = what == BODY
    digits = _count(classes & DIGIT != 0)
    clause = _among(code, _WORD_SETS[0]) & body
    plain = body & ~clause & (digits[end] - digits[first] < size)

    # segments: lines and sentences of a page without its links and tags
    gap = (classes & SPACE != 0) | (kind != BODY)
    stop = (codes == ord(".")) | (codes == ord("!")) | (codes == ord("?"))
    border = ((codes == 10) & (kind == BODY)) | (gap & np.r_[False, ((stop | (codes == ord("…"))) & ~gap)[:-1]])
    number = _count(border)[1:]  # of a character's segment
    raw_segment = number[first]
    used, segment = np.unique(raw_segment[body], return_inverse=True)
    m = len(used)
    if not m:
        bad = _per(page, pages, ~body)
        return total, bad
    seg_of = np.full(int(number[-1]) + 2, -1, dtype=np.int64)
    seg_of[used] = np.arange(m)
    seg = np.where(body, seg_of[raw_segment], -1)
    bw = np.flatnonzero(body)
    seg_page = np.zeros(m, dtype=np.int64)
    seg_page[segment] = page[bw]
    n_words, n_clause, n_chars = _per(segment, m), _per(segment, m, clause[bw]), _per(segment, m, size[bw])
    first_word = np.full(m, n, dtype=np.int64)
    first_word[segment[::-1]] = bw[::-1]

    # tokens between blanks: tickers and the ends of segments
    tok, tok_end = _runs(~gap)
    tok_seg = seg_of[number[tok]]
    letters, upper = _count(classes & LETTER != 0), _count(classes & UPPER != 0)
    caps = upper[tok_end] - upper[tok]
    likely = np.flatnonzero((tok_seg >= 0) & (caps > 0) & (caps == letters[tok_end] - letters[tok]) & (tok_end - tok >= 3))
    is_ticker = np.zeros(len(tok), dtype=bool)
    is_ticker[[t for t, a, b in zip(likely.tolist(), tok[likely].tolist(), tok_end[likely].tolist()) if _TICKER.match(joined[a:b])]] = True
    inside = tok_seg >= 0
    n_tokens, n_tickers = _per(tok_seg[inside], m), _per(tok_seg[inside], m, is_ticker[inside])
    last_tok = np.full(m, 0, dtype=np.int64)
    last_tok[tok_seg[inside]] = np.flatnonzero(inside)
    first_tok = np.full(m, 0, dtype=np.int64)
    first_tok[tok_seg[inside][::-1]] = np.flatnonzero(inside)[::-1]
    ends = stop[tok_end[last_tok] - 1]

    # rows of data: cells of which at least two, and two fifths, are numbers or dates
    solid = ~gap
    mark = solid & ((codes == ord("|")) | (codes == ord(";")))
    mark |= (codes == 9) & (kind == BODY)
    mark |= solid & (codes == ord(",")) & np.r_[gap[1:], True]
    edges = np.flatnonzero(mark | border)
    low, high = np.r_[0, edges + 1], np.r_[edges, len(codes)]
    filled, signs = _count(solid), _count(solid & (classes & (LETTER | WORD) != 0) & (classes & DIGIT == 0))
    cell = filled[high] > filled[low]
    numeric = cell & (digits[high] > digits[low]) & (signs[high] == signs[low])
    cell_seg = seg_of[number[np.minimum(low, len(codes) - 1)]]
    held = cell_seg >= 0
    cells, numbers = _per(cell_seg[held], m, cell[held]), _per(cell_seg[held], m, numeric[held])
    table = (cells >= 3) & (numbers >= 2) & (numbers >= 0.4 * cells)

    # code: brackets and assignments, or a line that begins with a statement's word
    signs = solid & (classes & BRACKET != 0)
    coded = np.zeros(m, dtype=bool)
    at = seg_of[number[np.flatnonzero(signs)]]
    coded[at[at >= 0]] = True
    name = (classes & WORD != 0) & (kind == BODY)
    calls = np.flatnonzero(signs & (codes == ord("(")))
    calls = calls[np.r_[False, name][calls]]
    equals = np.flatnonzero(signs & (codes == ord("=")))
    places = np.flatnonzero(solid)
    where = np.searchsorted(places, equals)
    prev, following = places[np.maximum(where - 1, 0)], places[np.minimum(where + 1, len(places) - 1)]
    equals = equals[name[prev] & (where > 0) & (following > equals) & (number[prev] == number[equals]) & (number[following] == number[equals])]
    statement = np.zeros(m, dtype=bool)
    at = seg_of[number[np.r_[calls, equals]]]
    statement[at[at >= 0]] = True
    opens = first[first_word] == tok[first_tok]
    low_case = opens & (classes[first[first_word]] & UPPER == 0)
    opening = _among(code[first_word], _WORD_SETS[1])
    coded |= opens & (opening | _among(code[first_word], _WORD_SETS[2]))
    statement |= low_case & opening

    # runs of tickers with few clauses
    tickers = (n_tickers >= TICKERS) & (n_tickers >= TICKER_SHARE * n_tokens) & (n_clause <= CLAUSE * n_words) & ~table

    # runs of lines without clauses
    line = (n_words <= LIST_WORDS) & ~ends & (n_clause <= CLAUSE * n_words + 1)
    loose = (line | ((n_words >= LIST_WORDS) & (n_clause <= CLAUSE * n_words - 1))) & ~coded & ~table & ~tickers
    run = np.cumsum(loose & ~(np.r_[False, loose[:-1]] & np.r_[False, seg_page[1:] == seg_page[:-1]])) - 1
    runs = int(run[-1]) + 1 if m else 0
    run_lines, run_words = _per(run[loose], runs), _per(run[loose], runs, n_words[loose])
    asked = (run_lines >= LIST_LINES) | (run_words >= LIST_WORDS)
    in_list = loose & asked[np.maximum(run, 0)] if runs else loose
    list_words = bw[in_list[segment]]

    # the automata: one of every whole page, one of every list
    token_of = np.searchsorted(tok, first, "right") - 1
    as_ticker = body & tickers[np.maximum(seg, 0)] & is_ticker[np.maximum(token_of, 0)] & (seg >= 0)
    symbol = code.copy()
    symbol[what == LINK], symbol[what == TAG], symbol[as_ticker] = _LINKS, _TAGS, _TICKERS
    thing = np.where(body, np.where(as_ticker, token_of, -1), np.searchsorted(items, first, "right") - 1)
    again = (symbol[1:] == symbol[:-1]) & (thing[1:] == thing[:-1]) & (thing[1:] >= 0) & (what[1:] == what[:-1]) if n > 1 else np.zeros(0, dtype=bool)
    head = np.r_[True, ~again]  # the first word of a link, tag or ticker stands for all of it
    element = np.cumsum(head) - 1
    fresh = head & np.r_[True, (raw_segment[1:] != raw_segment[:-1])]
    shift = np.cumsum(fresh[head]) - 1
    place = np.arange(len(shift)) + shift + 1  # a border that occurs once stands before each segment
    length = len(shift) + int(fresh.sum())
    symbols = np.arange(length, dtype=np.uint64) | np.uint64(1 << 63)
    owner = np.zeros(length, dtype=np.int64)
    symbols[place], owner[place] = symbol[head], page[head]
    borders = np.ones(length, dtype=bool)
    borders[place] = False
    owner[np.flatnonzero(borders)] = owner[np.flatnonzero(borders) + 1]
    automata = Automata(np.r_[symbols, code[list_words]], np.r_[owner, pages + run[seg[list_words]]])

    def spread(values: np.ndarray) -> np.ndarray:
        return values[place][element]

    twice = automata.covered(2)
    repeated = spread(twice[:length])
    bad_word = ~body & repeated
    shown = _per(seg[body], m, (as_ticker & repeated)[body])
    bad_seg = tickers & (shown >= TICKERS)

    # lists: repeats cover much of their characters, or half as much where most lines have a price
    if len(list_words):
        covered = _per(run[seg[list_words]], runs, size[list_words] * twice[length:])
        chars = _per(run[seg[list_words]], runs, size[list_words])
        money = solid & (classes & MONEY != 0)
        digit = (classes & DIGIT != 0) & solid
        blank = classes & SPACE != 0
        near = np.r_[digit[1:], False] | (np.r_[blank[1:], False] & np.r_[digit[2:], False, False]) | np.r_[False, digit[:-1]] | (np.r_[False, blank[:-1]] & np.r_[False, False, digit[:-2]])
        priced = np.zeros(m, dtype=bool)
        at = seg_of[number[np.flatnonzero(money & near)]]
        priced[at[at >= 0]] = True
        a, b = tok[last_tok], tok_end[last_tok]
        marks = _count((codes == ord(".")) | (codes == ord(",")))
        n_digits, n_marks = digits[b] - digits[a], marks[b] - marks[a]
        priced |= (n_digits > 0) & (n_digits + n_marks == b - a) & (n_marks <= 1) & digit[a] & digit[b - 1] & (last_tok > first_tok)
        offers = (2 * _per(run[loose], runs, priced[loose]) >= run_lines) & (run_lines >= LIST_LINES)
        is_list = asked & (covered >= LISTED * chars * np.where(offers, 0.5, 1.0))
        listed = in_list & is_list[np.maximum(run, 0)]
    else:
        listed = np.zeros(m, dtype=bool)

    # the rest of the page: keywords and stock phrases fill its segments
    rest = ~listed & ~tickers & ~table & ~statement
    n_rest = _per(seg_page, pages, np.where(rest, n_words, 0))
    is_clause, is_plain = np.zeros(length, dtype=bool), np.zeros(length, dtype=bool)
    is_clause[place], is_plain[place] = (clause | ~body)[head], plain[head]
    clauses, plains = _count(is_clause | borders), _count(is_plain)
    at = np.arange(length)
    hit = np.zeros(length, dtype=bool)
    often = automata.occurrences(1)[:length]
    for k in range(1, KEY_WORDS + 1):
        longer = automata.occurrences(k + 1)[:length]  # a state's longest substring loses occurrences with one more word
        big = (often >= KEY_TIMES) & (longer < often) & (often * k >= KEY_SHARE * n_rest[owner]) & (clauses[at + 1] == clauses[np.maximum(at - k + 1, 0)]) & (plains[at + 1] > plains[np.maximum(at - k + 1, 0)])
        last = np.flatnonzero(big)
        hit |= marked(last - k + 1, last, length)
        often = longer
    long = automata.longest(KEY_TIMES)[:length]
    last = np.flatnonzero((long > 0) & ~is_clause)
    begin = last - long[last] + 1
    open_at = np.where(is_clause, length, at)
    ahead = np.minimum.accumulate(open_at[::-1])[::-1]  # phrases lose the clause words at their ends
    begin = ahead[begin]
    keep = (begin < last) & (plains[last + 1] > plains[np.minimum(begin, length - 1)])
    phrase = marked(begin[keep], last[keep], length)

    def cover(marks: np.ndarray) -> np.ndarray:
        return _per(seg[body], m, (size * spread(marks))[body]) / n_chars

    stuffed = cover(hit) >= STUFFED
    in_rest = body & rest[np.maximum(seg, 0)]
    joint = _per(page[in_rest], pages, spread(phrase)[in_rest])
    share = cover(phrase)
    for least, most in FILLED:
        full = rest & (share >= least) & (joint >= JOINT_SHARE * n_rest)[seg_page]
        few = _per(seg_page, pages, np.where(full, n_clause, 0)) <= most * _per(seg_page, pages, np.where(full, n_words, 0))
        stuffed |= full & few[seg_page]
    bad_seg |= listed | (rest & stuffed)
    bad = _per(page, pages, bad_word) + _per(seg_page, pages, np.where(bad_seg, n_words, 0))
    return total, bad


def spam_shares(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each page, and the share of them in stuffed segments and in lists of links, tags, tickers or offers."""
    n_words, share = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts))
    part: list[int] = []
    held = 0
    for i, text in enumerate([*texts, None]):
        more = len(text) if text else 0
        if part and (i == len(texts) or held + more > SLICE_CHARS):
            words, bad = _measure([texts[j] for j in part])
            n_words[part] = words
            share[part] = np.where(words >= LEAST_WORDS, bad / np.maximum(words, 1), 0.0)
            part, held = [], 0
        if text:
            part.append(i)
            held += more
    return n_words, share


def spam_share(text: str | None) -> tuple[int, float]:
    """Words and spam share of one page."""
    n_words, share = spam_shares([text])
    return int(n_words[0]), float(share[0])


def spam_pages(documents: DataFrame, id: str, text: str, share: float = SPAM_SHARE) -> DataFrame:
    """Pages of which more than ``share`` of the words are spam: ``id, n_words, spam_share``.

    Every page has a suffix automaton over its whole text, in which a link with its anchor, a tag and a ticker in a run of
    tickers are one symbol each, and every other word its own; borders between lines and sentences occur once. What counts
    lies under repeated maximal substrings of it: links and tags, and runs of tickers, that repeat; and sentences or lines of
    which two fifths of the characters lie under large keywords (short, without clause words, alone a twentieth of the
    page), or under all repeated phrases together (of any length, without the clause words at their ends); the latter
    only where at most a sixth of the words of the sentences so filled are clause words, or a third where nine tenths of each
    are filled: long articles repeat phrases too. Lines without clauses are a list of offers or tags if, in the automaton of the
    list alone, repeated substrings cover much of their characters. Rows of data, code and prose are left alone.

    Distribution: pages are independent, measured where they are read, and nothing is shuffled. The automata of about a
    million characters of pages are built together in arrays. Whole pages count, and the share is never cut short. Words are
    compared by 64-bit codes.

    Nulls: a null or empty text, or one of fewer than 20 words, is no spam. A null id comes out as null. A page
    delivered twice comes out twice. Empty in, empty out. Other columns are ignored.
    """
    schema = documents.select(F.col(id).alias("i")).schema.add("n_words", "long").add("spam_share", "double")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n_words, shares = spam_shares(pdf["t"].tolist())
            out = pd.DataFrame({"i": pdf["i"], "n_words": n_words, "spam_share": shares})
            yield out[out["spam_share"] > share]

    return documents.select(F.col(id).alias("i"), F.col(text).alias("t")).mapInPandas(measure, schema).withColumnRenamed("i", id)
