"""License scans by template markup.

A template is license wording with markup: text between <<beginOptional>> and
<<endOptional>> may be missing, and <<var;a-b>> stands for a to b words of any
kind.  Templates compile into token automata; a stretch of a text is accepted
if its words are the mandatory wording exactly, with nothing in between but
what the markup allows.
"""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# One-line notices, with this module's markup.
NOTICES = {
    "mit-notice": "<<beginOptional>> is <<endOptional>> released under the <<beginOptional>> terms of the <<endOptional>> MIT license",
    "apache-2.0-notice": "licensed under the Apache License <<beginOptional>> , Version <<endOptional>> 2.0 <<beginOptional>> (the License) <<endOptional>>",
    "gpl-3.0-notice": "licensed under the GNU General Public License <<beginOptional>> (GPL) <<endOptional>> , version 3 <<beginOptional>> .0 <<endOptional>>",
    "gpl-2.0-notice": "licensed under the GNU General Public License <<beginOptional>> (GPL) <<endOptional>> , version 2 <<beginOptional>> .0 <<endOptional>>",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>> a Creative Commons license <<var;0-3>> <<endOptional>> CC BY-NC 4.0",
    "cc-by-4.0-notice": "licensed under <<beginOptional>> a <<endOptional>> Creative Commons Attribution 4.0 International <<beginOptional>> Public <<endOptional>> License",
    "cc-by-sa-4.0-notice": "licensed under <<beginOptional>> a <<endOptional>> Creative Commons Attribution-ShareAlike 4.0 International <<beginOptional>> Public <<endOptional>> License",
}


def read_templates(folder: str) -> dict[str, str]:
    """Marked-up templates by label: the .txt files of a folder of the driver's."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


#: The notices and the license texts and headers in the folder `templates` beside this module.
TEMPLATES = NOTICES | read_templates(str(Path(__file__).with_name("templates")))

#: Bytes of a word: letters and digits of ASCII, lower-cased, and all of other characters; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ANY = None


def words_of(data: bytes) -> list[bytes]:
    """Words of a UTF-8 text: runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F], A-Z lower-cased."""
    return data.translate(_FOLD).split()


class Automaton:
    """A template's token automaton: states are numbered in the order of the wording."""

    def __init__(self, template: str):
        self.step: list[list[tuple[bytes | None, int]]] = [[]]
        self.skip: list[list[int]] = [[]]
        self.depth = [0]  # mandatory words before each state
        state, opened, anchor, done = 0, [], [], False
        for part in re.split(r"(<<[^<>]*>>)", template):
            if part == "<<beginOptional>>":
                opened.append(state)
            elif part == "<<endOptional>>":
                self.skip[opened.pop()].append(state)
            elif m := re.fullmatch(r"<<var;(\d+)-(\d+)>>", part):
                low, high = map(int, m.groups())
                skips = []
                for i in range(high):
                    if i >= low:
                        skips.append(state)
                    state = self._then(state, ANY, False)
                for s in skips:
                    self.skip[s].append(state)
            else:
                for w in words_of(part.encode()):
                    state = self._then(state, w, not opened)
                    if not opened and not done:
                        anchor.append(w)
            done |= bool(anchor) and part.startswith("<<")
        if opened or not anchor:
            raise ValueError("a template needs mandatory words and closed optional regions")
        self.accept, self.mandatory = state, self.depth[state]
        self.anchor = b" " + b" ".join(anchor[:3]) + b" "
        self.first = next(s for s in range(len(self.step)) if any(t == anchor[0] for t, _ in self.step[s]) and self.depth[s] == 0)

    def _then(self, state: int, token: bytes | None, mandatory: bool) -> int:
        self.step.append([])
        self.skip.append([])
        self.depth.append(self.depth[state] + mandatory)
        self.step[state].append((token, len(self.step) - 1))
        return len(self.step) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """Mandatory words matched, in order, by the best run from words[at] on."""
        states, best = self._closure({self.first}), 0
        while True:
            best = max(best, max(self.depth[s] for s in states))
            if self.accept in states:
                return self.mandatory
            if at >= len(words):
                return best
            states = self._closure({n for s in states for t, n in self.step[s] if t is ANY or t == words[at]})
            if not states:
                return best
            at += 1


def scan(data: bytes, automata: dict[str, Automaton], phrases: dict[bytes, str]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    words = words_of(data)
    text = b" " + b" ".join(words) + b" "

    def places(needle):
        """Numbers of the words from which the needle's words stand; the text is counted through once."""
        at, seen, word = text.find(needle), 0, 0
        while at >= 0:
            word += text.count(b" ", seen, at)
            seen = at
            yield word
            at = text.find(needle, at + 1)

    n, first, last, base = 0, None, None, set()
    for phrase, label in phrases.items():
        for at in places(phrase):
            n += 1
            first, last = min(at, at if first is None else first), max(at, last or 0)
            base.add(label)
    labels, score = set(base), 0.5 if base else 0.0
    for label, a in automata.items():
        for at in places(a.anchor):
            got = a.match(words, at)
            score = max(score, got / a.mandatory)
            if got == a.mandatory:
                labels.add(label)
                break
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def _scans(templates: dict[str, str], phrases: dict[str, str]):
    def run(batches):
        automata = {k: Automaton(t) for k, t in templates.items()}
        needles = {b" " + k.encode() + b" ": v for k, v in phrases.items()}
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            rows = [scan(t.as_py() or b"", automata, needles) for t in b.column(1)]
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...).

    n_base, first_word, last_word and base_labels tell of the phrases; labels
    adds every template that accepts a stretch of the text.  score is the
    largest share of a template's mandatory words matched from their start on
    (at least 0.5 where there is a phrase, 1 where a template accepts).  A null
    text is empty: no words, no labels (empty strings), score 0; very long texts
    are read whole, each in one task; rows without a doc_id and repeated rows
    are scanned like any other; other columns are not read; an empty table gives
    no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("binary"))
    return rows.mapInArrow(_scans(templates, phrases), f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
