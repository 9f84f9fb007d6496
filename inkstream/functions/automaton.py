"""Keyword lists by one Aho-Corasick automaton (F22-F24, F72, J17): one pass over a text, whatever the number of keywords.

All lists that are looked for in a text go into one automaton, which workers build once and keep. A pass gives the
keywords that occur, as counts of distinct ones for each list, or by name. Keywords and texts are compared in lower case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where a keyword may stand: anywhere; as a whole word; as a whole word if it has up to three characters.
ANYWHERE, WHOLE, SHORT_WHOLE = "anywhere", "whole", "short"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_Lists = tuple[tuple[tuple[str, ...], str], ...]


@lru_cache(maxsize=16)
def _built(lists: _Lists) -> ahocorasick.Automaton:
    """Each distinct keyword's value: its length, and (list, number, whole word only) for each place that it has."""
    places: dict[str, list[tuple[int, int, bool]]] = {}
    for i, (keywords, edges) in enumerate(lists):
        for j, k in enumerate(keywords):
            places.setdefault(k.lower(), []).append((i, j, edges == WHOLE or edges == SHORT_WHOLE and len(k) <= 3))
    out = ahocorasick.Automaton()
    for k, at in places.items():
        if k:
            out.add_word(k, (len(k), all(whole for *_, whole in at), at))
    out.make_automaton()
    return out


def occurring(lists: _Lists, text: str) -> set[tuple[int, int]]:
    """(list, number) of every keyword that occurs in a text in lower case."""
    machine, found, open_ = _built(lists), set(), {}
    for end, value in machine.iter(text) if len(machine) else ():
        size, only_whole, at = value
        if open_.get(id(value)) is False:  # nothing more to find by this keyword
            continue
        edge = (end < size or text[end - size] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD)
        if edge or not only_whole:
            found.update((i, j) for i, j, whole in at if edge or not whole)
            open_[id(value)] = False if edge or not any(whole for *_, whole in at) else True
    for i, (keywords, _) in enumerate(lists):  # an empty keyword is part of every text
        found.update((i, j) for j, k in enumerate(keywords) if not k)
    return found


def _frozen(lists: Iterable[tuple[Iterable[str], str]]) -> _Lists:
    return tuple((tuple(dict.fromkeys(keywords)), edges) for keywords, edges in lists)


def _counts(lists: _Lists) -> Callable[[pa.Array], pa.Array]:
    def count(texts: pa.Array) -> pa.Array:
        rows = []
        for text in texts.to_pylist():
            if text is None:
                rows.append(None)
                continue
            row = [0] * len(lists)
            for i, _ in occurring(lists, text):
                row[i] += 1
            rows.append(row)
        return pa.array(rows, pa.list_(pa.int32()))

    return count


class Hits:
    """What occurs of some named lists in a text. Lists: name -> keywords, or (keywords, where they may stand)."""

    def __init__(self, x: Column, lists: dict[str, list[str] | tuple[list[str], str]], edges: str = SHORT_WHOLE):
        named = {name: of if isinstance(of, tuple) else (of, edges) for name, of in lists.items()}
        self.place = {name: i for i, name in enumerate(named)}
        self.column = F.arrow_udf(_counts(_frozen(named.values())), "array<int>")(F.lower(x))

    def count(self, name: str) -> Column:
        """how many distinct keywords of a list occur; null for a null text."""
        return F.get(self.column, F.lit(self.place[name]))

    def any(self, name: str) -> Column:
        """some keyword of a list occurs."""
        return self.count(name) > 0


def named_in(fields: list[Column], names: list[str], edges: str = ANYWHERE) -> Column:
    """The names that occur in some of the fields, in the list's order: an array of (name, field), ``field`` being the
    number of the first one that has it. Null fields have no names."""
    lists = _frozen([(names, edges)])
    kind = pa.list_(pa.struct([("name", pa.string()), ("field", pa.int32())]))

    def find(*columns: pa.Array) -> pa.Array:
        rows = []
        for texts in zip(*(c.to_pylist() for c in columns), strict=True):
            first: dict[int, int] = {}
            for f, text in enumerate(texts):
                for _, j in occurring(lists, text) if text is not None else ():
                    first.setdefault(j, f)
            rows.append([{"name": lists[0][0][j], "field": first[j]} for j in sorted(first)])
        return pa.array(rows, kind)

    return F.arrow_udf(find, "array<struct<name: string, field: int>>")(*[F.lower(x) for x in fields])
