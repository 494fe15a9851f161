"""Licence scans: runs of lines compared with licence templates by the Dice coefficient over word bigrams.

A run of n bigrams and a template of m can reach a coefficient t only if n lies between m·t/(2-t) and
m·(2-t)/t; templates of other sizes are passed over. A line without any bigram of a template would
only lower the coefficient at the start or end of a run, so nearly all lines of ordinary text are left after one look-up per word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed_texts, small_batches
from .licence_texts import NOTICES, TEXTS

THRESHOLD = 0.85
TEMPLATES = NOTICES + TEXTS

_WORD = re.compile(r"[a-z0-9]+")
_SCHEMA = "doc_id long, licence string, dice double, first_line long, n_lines long"


def normalised(text: str) -> list[str]:
    """Words of lower-case letters and digits; everything else separates them."""
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    """Pairs of neighbouring words with their numbers; a lone word is paired with nothing."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, "") for w in words)


def dice(a: Counter, b: Counter) -> float:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    both = sum(min(n, large[k]) for k, n in small.items() if k in large)
    total = sum(a.values()) + sum(b.values())
    return 2 * both / total if total else 0.0


class Templates:
    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self._all = [(name, bigrams(normalised(text))) for name, text in templates]
        self._threshold = threshold
        self._sizes = []
        for name, grams in self._all:
            size = sum(grams.values())
            self._sizes.append((size * threshold / (2 - threshold), size * (2 - threshold) / threshold))
        self._largest = max((high for _, high in self._sizes), default=0)
        self._known = {gram for _, grams in self._all for gram in grams}

    def find(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, lines): the best runs that do not overlap, one for each licence.

        Runs of whole lines come first; lines in none of them are searched for runs of their words.
        """
        words = [normalised(line) for line in text.split("\n")]
        marked = self._marked(words)
        matches: list[tuple[float, int, int, str]] = []
        for at, first in enumerate(marked):
            run: list[str] = []
            done = first
            for last in marked[at:]:
                for line in words[done : last + 1]:
                    run += line
                done = last + 1
                if len(run) - 1 > self._largest:
                    break
                matches += [(-value, done - first, first, name) for name, value in self._compare(run)]
        found = best_runs(matches)
        names, taken = {f[0] for f in found}, {i for _, _, first, n in found for i in range(first, first + n)}
        inside = [(-value, 1, i, name) for i in marked if i not in taken for name, value in self._inside(words[i])]
        return sorted(found + best_runs([m for m in inside if m[3] not in names]))

    def _inside(self, line: list[str]) -> list[tuple[str, float]]:
        """The best run of a line's words for each template, starting and ending with bigrams of it.

        A run that goes on with words of some template is a part of a longer text and not reported.
        """
        grams = list(zip(line, line[1:]))
        known, found = [g in self._known for g in grams], []
        for (name, template), (low, high) in zip(self._all, self._sizes):
            size, most, width = sum(template.values()), 0.0, int(high)
            if len(grams) < low or sum(known) < low:
                continue
            at = [i for i, g in enumerate(grams) if known[i] and g in template]
            # Bigrams shared with the template in the widest run from each start, each as often as it has them.
            own: Counter = Counter()
            both = end = 0
            for k, start in enumerate(at):
                while end < len(at) and at[end] < start + width:
                    gram = grams[at[end]]
                    both += own[gram] < template[gram]
                    own[gram] += 1
                    end += 1
                if both >= low and (start == 0 or not known[start - 1]):
                    here: Counter = Counter()
                    shared = 0
                    for i in at[k:end]:
                        shared += here[grams[i]] < template[grams[i]]
                        here[grams[i]] += 1
                        if i + 1 == len(grams) or not known[i + 1]:
                            most = max(most, 2 * shared / (size + i - start + 1))
                gone = grams[start]
                own[gone] -= 1
                both -= own[gone] < template[gone]
            if most >= self._threshold:
                found.append((name, most))
        return found

    def _marked(self, words: list[list[str]]) -> list[int]:
        """Lines with a word of a template's bigram, within the line or across a border; others end no best run."""
        known, marked, before = self._known, set(), None
        for i, line in enumerate(words):
            if not line:
                continue
            if not known.isdisjoint(zip(line, line[1:])) or (len(line) == 1 and (line[0], "") in known):
                marked.add(i)
            if before is not None and (words[before][-1], line[0]) in known:
                marked.update((before, i))
            before = i
        return sorted(marked)

    def _compare(self, run: list[str]) -> list[tuple[str, float]]:
        size, grams, found = max(1, len(run) - 1), None, []
        for (name, template), (low, high) in zip(self._all, self._sizes):
            if low <= size <= high:
                grams = bigrams(run) if grams is None else grams
                value = dice(grams, template)
                if value >= self._threshold:
                    found.append((name, value))
        return found


def best_runs(matches: list[tuple[float, int, int, str]]) -> list[tuple[str, float, int, int]]:
    """From (minus coefficient, lines, first line, licence): the best first, without those that overlap a better one."""
    taken: set[int] = set()
    best: dict[str, tuple[float, int, int]] = {}
    for value, lines, first, name in sorted(matches):
        own = range(first, first + lines)
        if name not in best and taken.isdisjoint(own):
            best[name] = (-value, first, lines)
            taken.update(own)
    return [(name, *found) for name, found in sorted(best.items())]


def scan_licences(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, licence, dice, first_line and n_lines of licence texts in documents.

    One row per document row and licence, for the run of lines that is most like one of its templates, or else
    for a line that holds such a run of words among others; runs
    that overlap one with a higher coefficient are left out (of equal ones the shorter, then the
    earlier stays, then the first by name). Missing and empty texts and lines without words hold nothing.
    Repeated rows are reported each; other columns are left out. A list of templates without
    entries, or an empty table, gives no rows.
    """
    templates = tuple(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compared = Templates(templates, threshold)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *found) for found in compared.find(text)]
            if rows:
                names = ["doc_id", "licence", "dice", "first_line", "n_lines"]
                kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return keyed_texts(docs).mapInArrow(scan, _SCHEMA)
