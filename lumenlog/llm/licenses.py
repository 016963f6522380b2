"""License scan: template markup compiled into token automata.

A template is a text with ``<<beginOptional>> ... <<endOptional>>`` around what may be missing (nested if need be) and
``<<var;name="holder";words="1-8">>`` where 1 to 8 words of any kind may stand. All else is mandatory wording and has to stand word for word, in order.
Texts and templates are compared as words, A-Z in lower case: runs of letters, digits and all characters beyond ASCII.

The templates make one automaton over words. A state waits for one word, or for any word inside a region; optional parts and
what a region may leave out are settled when it is compiled, by giving a state all states that can follow. It is run from
the words a template can begin with, in texts that have all its mandatory words, and as long as a state is alive.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bytes to words: A-Z to a-z; a-z, 0-9 and the bytes of other characters stay; the rest separates
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MARK = re.compile(r"<<(.*?)>>", re.S)
_PLACE = pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "_n_words long, _places array<struct<template:int,label:string,start:bigint,end:bigint>>, _covered long"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


@dataclass
class Automaton:
    """``word``: state -> the word it waits for (absent: any word); ``follow``: state -> the states after it; a negative state
    -1 - t accepts template t."""
    labels: list[str] = field(default_factory=list)
    word: dict[int, bytes] = field(default_factory=dict)
    follow: list[tuple[int, ...]] = field(default_factory=list)
    starts: list[tuple[int, ...]] = field(default_factory=list)  # of each template
    required: list[frozenset[bytes]] = field(default_factory=list)  # mandatory words of each template
    plain: list[bool] = field(default_factory=list)  # templates without markup

    def add(self, label: str, template: str) -> None:
        parts, t = parse(template), len(self.labels)
        if not any(isinstance(p, bytes) for p in parts):
            raise ValueError(f"template {t} ({label}) has no mandatory wording")
        first = self._chain(parts, frozenset([-1 - t]))
        if -1 - t in first or any(s not in self.word for s in first):
            raise ValueError(f"template {t} ({label}) needs a word before its first region")
        if not isinstance(parts[-1], bytes) and parts[-1][0] == "any":
            raise ValueError(f"template {t} ({label}) ends in a region")
        self.starts.append(tuple(first))
        self.labels.append(label)
        self.required.append(frozenset(p for p in parts if isinstance(p, bytes)))
        self.plain.append(all(isinstance(p, bytes) for p in parts))

    def _state(self, after: frozenset[int], word: bytes | None) -> int:
        self.follow.append(tuple(sorted(after)))
        if word is not None:
            self.word[len(self.follow) - 1] = word
        return len(self.follow) - 1

    def _chain(self, parts: list, after: frozenset[int]) -> frozenset[int]:
        """The states that wait for the first word of ``parts``, if ``after`` wait for what comes behind."""
        for p in reversed(parts):
            if isinstance(p, bytes):
                after = frozenset([self._state(after, p)])
            elif p[0] == "optional":
                after |= self._chain(p[1], after)
            else:
                low, high = p[1:]
                skip = after
                for left in range(high):  # from the last word of the region to its first
                    now = frozenset([self._state(after, None)])
                    after = now | skip if left + 1 <= high - low else now
        return after

    def longest(self, t: int, words: list[bytes], at: int) -> int:
        """The end of the longest place of template t that starts at ``at``; 0 if there is none. Ends after at most the words of the
        template with all its options and full regions."""
        end, active = 0, {s for s in self.starts[t] if self.word[s] == words[at]}
        for i in range(at, len(words)):
            after = {f for s in active if self.word.get(s, words[i]) == words[i] for f in self.follow[s]}
            active = {f for f in after if f >= 0}
            if len(active) < len(after):
                end = i + 1
            if not active:
                break
        return end

    def places(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, start, end), by start, template: every place of templates without markup; of the others, from the left,
        the longest that does not overlap the one before."""
        present, out = set(words), []
        spots: dict[bytes, list[int]] = {}
        for t, needed in enumerate(self.required):
            if not needed <= present:
                continue
            first = {self.word[s] for s in self.starts[t]} & present
            for w in first - spots.keys():
                spots[w] = [i for i, x in enumerate(words) if x == w]
            upto = 0
            for at in sorted(i for w in first for i in spots[w]):
                if (at >= upto or self.plain[t]) and (end := self.longest(t, words, at)):
                    out.append((t, at, end))
                    upto = end
        return sorted(out, key=lambda p: (p[1], p[0]))


def parse(template: str) -> list:
    """Words (bytes), ("optional", parts) and ("any", low, high) of a template."""
    stack: list[list] = [[]]
    at = 0
    for m in _MARK.finditer(template):
        stack[-1] += words_of(template[at:m.start()].encode())
        at, mark = m.end(), m[1].strip()
        if mark.lower().startswith("beginoptional"):
            stack.append([])
        elif mark.lower() == "endoptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            if inner:
                stack[-1].append(("optional", inner))
        elif mark.startswith("var;"):
            size = re.search(r'words="(\d+)-(\d+)"', mark)
            if not size or int(size[1]) > int(size[2]):
                raise ValueError(f'a region needs words="low-high": {mark!r}')
            stack[-1].append(("any", int(size[1]), int(size[2])))
        else:
            raise ValueError(f"unknown markup {mark!r}")
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0] + words_of(template[at:].encode())


def compile_templates(templates: Sequence[tuple[str, str]]) -> Automaton:
    """One automaton of (label, template) pairs. A template has at least one mandatory word outside its optional parts, a word before its
    first region and no region at its end."""
    out = Automaton()
    for label, text in templates:
        out.add(label, text)
    return out


def license_scan(docs: DataFrame, templates: Sequence[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, _n_words, _places, _covered): one row per row of ``docs``.

    ``_places``: (template, label, start, end) in words from 0, end exclusive, by start, then template: where the mandatory wording of a
    template stands exactly, with any of its optional parts and any replacement of its regions. Templates without markup give
    all their places, also overlapping ones; the others the longest from the left. ``_covered``: words inside any place.

    A null or empty text has no words and no places. Repeated rows and null or repeated ids get a result each; other
    columns are ignored, whatever their names. An empty table gives an empty result. Time is linear in a text for given templates."""
    machine = compile_templates(templates)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            counts, places, covered = [], [], []
            for text in b.column(1):
                raw = text.as_buffer()
                words = words_of(raw.to_pybytes()) if raw is not None else []
                found = machine.places(words)
                inside, upto = 0, 0
                for _, start, end in found:
                    inside += max(0, end - max(start, upto))
                    upto = max(upto, end)
                counts.append(len(words))
                covered.append(inside)
                places.append([{"template": t, "label": machine.labels[t], "start": x, "end": y} for t, x, y in found])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(covered, pa.int64())],
                names=[id_col, "_n_words", "_places", "_covered"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
