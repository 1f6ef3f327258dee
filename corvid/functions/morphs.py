"""Morphological tokens: the cheapest path through a lattice of dictionary entries and unknown words.

A text is cut at white space. Over each piece lie the dictionary's entries, wherever they occur, and guesses for what it
doesn't have: runs of letters, of digits, single marks, and up to ``LONGEST`` Hangul syllables as a noun. A path costs its
entries and the joins of their tags; of equally cheap paths the one with fewer entries counts, then that whose last entry
is the longer one. Marks are no tokens. The time grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

# Tags of marks, which are dropped, and what is marked by which.
MARKS = {"SF": ".!?。", "SP": ",:;/·", "SS": "\"'()[]{}<>‘’“”「」『』《》", "SE": "…", "SO": "-~–—"}
OTHER = "SW"
DROPPED = frozenset([*MARKS, OTHER])
NOUN, LETTERS, DIGITS, START = "NN", "SL", "SN", "^"
#: Particles, endings, and stems that endings follow, by tag and cost.
ENTRIES = {
    ("JX", 0.3): "은 는 이 가 을 를 의 에 에서 에게 께 께서 로 으로 와 과 도 만 까지 부터 보다 처럼 마다 조차 이나 나 라도 이라도 이란 란",
    ("EF", 0.3): "다 니다 습니다 어요 아요 해요 세요 십시오 까 니까 고 며 면 면서 지만 는데 은 는 을 어 아 여 게 지 기 음 려고 도록 어서 아서 해서 거나 든지",
    ("XS", 0.5): "하 되 시키 받 당하 했 됐 한 된 할 될 합 됩",
    ("VV", 2.0): "있 없 알 모르 가 오 보 주 받 내 쓰 바꾸 신청하 해지하 확인하 이용하 가입하 변경하 문의하",
    ("EP", 0.3): "시 으시 았 었 겠 였",
}
JOINS = {
    ("NN", "JX"): 0.0, ("NN", "XS"): 0.0, ("XS", "EF"): 0.0, ("XS", "EP"): 0.0, ("VV", "EF"): 0.0, ("VV", "EP"): 0.0, ("EP", "EF"): 0.0, ("EP", "EP"): 0.5, ("^", "NN"): 0.0, ("^", "VV"): 0.3, ("JX", "JX"): 0.7, ("EF", "JX"): 1.0,
    ("SN", "NN"): 0.0, ("SL", "JX"): 0.0, ("SN", "JX"): 0.0, ("NN", "NN"): 1.5, ("^", "SL"): 0.0, ("^", "SN"): 0.0,
}
LONGEST = 8


@dataclass(frozen=True)
class Lexicon:
    """Entries (form, tag, cost), costs of joins by (tag, tag), what any other join costs, and what a guessed noun does: once and a syllable."""

    entries: tuple[tuple[str, str, float], ...] = tuple((form, tag, cost) for (tag, cost), forms in ENTRIES.items() for form in forms.split())
    joins: dict[tuple[str, str], float] = field(default_factory=lambda: dict(JOINS))
    other: float = 3.0
    unknown: tuple[float, float] = (2.0, 0.8)

    def __post_init__(self):
        table: dict[str, list[tuple[str, float]]] = {}
        for form, tag, cost in self.entries:
            table.setdefault(form, []).append((tag, cost))
        object.__setattr__(self, "table", table)
        object.__setattr__(self, "lengths", sorted({len(f) for f in table}))

    def edges(self, piece: str, at: int) -> Iterator[tuple[int, str, float]]:
        """(end, tag, cost) of what may begin at a place of a piece."""
        for n in self.lengths:
            if at + n <= len(piece):
                for tag, cost in self.table.get(piece[at : at + n], ()):
                    yield at + n, tag, cost
        kind = _kind(piece[at])
        if kind == NOUN:
            end = at
            while end < len(piece) and end - at < LONGEST and _kind(piece[end]) == NOUN:
                end += 1
                yield end, NOUN, self.unknown[0] + self.unknown[1] * (end - at)
        elif kind in (LETTERS, DIGITS):
            if at == 0 or _kind(piece[at - 1]) != kind:
                end = at
                while end < len(piece) and _kind(piece[end]) == kind:
                    end += 1
                yield end, kind, 0.0
        else:
            yield at + 1, kind, 0.0

    def path(self, piece: str) -> list[tuple[str, str]]:
        """(form, tag) along the cheapest path."""
        # By place and last tag: (cost, entries), and the place and tag that came before.
        best: list[dict[str, tuple]] = [{} for _ in range(len(piece) + 1)]
        best[0][START] = ((0.0, 0), None, None)
        for at in range(len(piece)):
            if not best[at]:
                continue
            for end, tag, cost in self.edges(piece, at):
                for last, (rank, _, _) in best[at].items():
                    joined = 0.0 if tag in DROPPED or last in DROPPED else self.joins.get((last, tag), self.other)
                    new = (round(rank[0] + joined + cost, 9), rank[1] + 1)
                    old = best[end].get(tag)
                    if old is None or (new, at, last) < (old[0], old[1], old[2]):
                        best[end][tag] = (new, at, last)
        at, tag, out = len(piece), min(best[-1], key=lambda t: (best[-1][t][0], t)), []
        while at:
            _, before, last = best[at][tag]
            out.append((piece[before:at], tag))
            at, tag = before, last
        return out[::-1]


def _kind(c: str) -> str:
    if "가" <= c <= "힣" or "ㄱ" <= c <= "ㅣ":
        return NOUN
    if c.isdecimal():
        return DIGITS
    if c.isalpha() or c == "_" or "̀" <= c <= "ͯ":
        return LETTERS
    return next((tag for tag, marks in MARKS.items() if c in marks), OTHER)


def tokens_of(text: str, lexicon: Lexicon, known: dict[str, list[str]] | None = None) -> list[str]:
    """The forms of a text, marks dropped. ``known`` remembers pieces."""
    known, out = {} if known is None else known, []
    for piece in text.split():
        if (found := known.get(piece)) is None:
            if len(known) > 200_000:
                known.clear()
            found = known[piece] = [form for form, tag in lexicon.path(piece) if tag not in DROPPED]
        out += found
    return out


def tokenizer(lexicon: Lexicon | None = None):
    """A tokenizer for :func:`corvid.operators.metrics.bleu`: a column of texts to a column of their tokens."""
    lexicon = lexicon or Lexicon()

    @F.pandas_udf("array<string>")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, list[str]] = {}
        for texts in parts:
            yield pd.Series([tokens_of(t or "", lexicon, known) for t in texts], dtype=object)

    return lambda text: tokens(text)


def words(entries: Iterable[str], tag: str = NOUN, cost: float = 1.0) -> tuple[tuple[str, str, float], ...]:
    """Entries of a user's own words."""
    return tuple((w, tag, cost) for w in entries)
