"""License scans: Aho-Corasick for tags and notices, shunting-yard for expressions (operator 5).

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters.
One Aho-Corasick automaton over the word stream (words joined by single spaces) finds the
notice phrases; a second one over the lower-cased text finds identifier tags
(``SPDX-License-Identifier:``). What follows a tag on its line is read as a licence expression by a
shunting-yard parser (``or`` < ``and`` < ``with``, parentheses) and evaluated:
``permissive`` holds for ``a or b`` if either side does, for ``a and b`` if both do, and
``with`` keeps its left side's verdict. Labels are those of the phrases plus, for the
expressions, every licence named (``spdx:<id>``).

The score is 1 for a document with a well-formed tag; otherwise ``1 - 0.5 ** notices`` for
the number of notice places, so 0 without any sign of a licence.

Scale: one map over the documents with no shuffle; the automata are small fixed tables.

Cases: null and empty texts have no words, no labels and score 0; a tag without a
readable expression gives the label ``spdx:invalid`` and counts as a notice; repeated rows
give the same result each; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremolo.llm.common import add_columns
from tremolo.llm.tokens import ALNUM_WORD, Slice

BASE_PHRASES = {"mit license": "mit", "apache license": "apache",
                "general public license": "gpl"}
#: further notice phrases of the method, with their labels
MORE_PHRASES = {
    "mit licence": "mit", "apache licence": "apache", "general public licence": "gpl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "isc license": "isc", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "cc0": "cc0",
    "creative commons zero": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx-license-identifier:"
PERMISSIVE = ("mit", "apache", "bsd", "isc", "zlib", "unlicense", "cc0", "0bsd", "cc-by-4",
              "cc-by-3", "python", "postgresql", "bsl", "wtfpl")
LEVEL = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[a-z0-9.+:-]+")


def automaton(words: dict[str, str] | list[str]):
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(w, w)
    found.make_automaton()
    return found


def parse_expression(line: str, at: int = 0, stop: int | None = None
                     ) -> list[tuple[str, str]] | None:
    """Postfix form of the longest readable expression at the start of a line, or None;
    ``at`` and ``stop`` bound the line in a longer text.

    Items are ("id", name) or ("op", operator). Reading stops at the first place where the
    expression can't go on (comment ends, prose), with all parentheses closed.
    """
    out: list[tuple[str, str]] = []
    ops: list[str] = []
    best, operand = None, True  # operand: an identifier or "(" must come next
    stop = len(line) if stop is None else stop
    while at < stop:
        if line[at] in " \t":
            at += 1
            continue
        m = _TOKEN.match(line, at, stop)
        if not m:
            break
        token, at = m.group(), m.end()
        if operand and token == "(":
            ops.append(token)
        elif operand and token not in LEVEL and token != ")":
            out.append(("id", token))
            operand = False
        elif not operand and token in LEVEL:
            while ops and ops[-1] != "(" and LEVEL[ops[-1]] >= LEVEL[token]:
                out.append(("op", ops.pop()))
            ops.append(token)
            operand = True
        elif not operand and token == ")" and "(" in ops:
            while ops[-1] != "(":
                out.append(("op", ops.pop()))
            ops.pop()
        else:
            break
        if not operand and "(" not in ops:
            # so much of the output (which only grows), and the few operators still open
            best = len(out), [("op", o) for o in reversed(ops)]
    return best and out[:best[0]] + best[1]


def evaluate(postfix: list[tuple[str, str]], holds) -> bool:
    """Value of an expression when ``holds(name)`` tells it of a licence."""
    stack: list[bool] = []
    for kind, name in postfix:
        if kind == "id":
            stack.append(holds(name))
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(left or right if name == "or" else
                         left and right if name == "and" else left)
    return stack[0]


def is_permissive(name: str) -> bool:
    return name.startswith(PERMISSIVE)


def _automata():
    phrases = {**BASE_PHRASES, **MORE_PHRASES}
    return automaton([f" {p} " for p in phrases]), automaton([TAG]), phrases


def _scan(s: Slice, state) -> dict[str, list]:
    notices, tags, phrases = state
    words = s.words(ALNUM_WORD, lower=True)
    got: dict[str, list] = {c: [] for c in (
        "base_starts", "base_labels", "labels", "expressions", "permissive", "score")}
    lower = words.data
    for row in range(s.rows):
        lo, hi = int(words.first[row]), int(words.first[row + 1])
        base: list[int] = []
        base_labels: set[str] = set()
        labels: set[str] = set()
        longest: dict[int, str] = {}
        places = 0
        raw = lower[s.offsets[row]:s.offsets[row + 1]].tobytes()
        if hi > lo:
            # the words joined by single spaces: separators become spaces, runs of them one
            flat = _RUNS.sub(" ", f" {raw.translate(_TO_SPACE).decode()} ")
            spaces = seen = 0  # spaces up to the end of a match; ends only grow
            for end, padded in notices.iter(flat):
                phrase = padded[1:-1]
                spaces += flat.count(" ", seen, end + 1)
                seen = end + 1
                start = spaces - padded.count(" ")
                longest[start] = phrase  # of phrases that start together the longest ends last
                if phrase in BASE_PHRASES:
                    base.append(start)
                    base_labels.add(phrases[phrase])
            labels.update(base_labels, (phrases[p] for p in longest.values()))
            places = len(longest)
        expressions, permissive, valid = [], None, False
        if b"spdx" in raw:
            text = raw.decode()
            ends = [end + 1 for end, _ in tags.iter(text)]
            for k, end in enumerate(ends):  # an expression ends at the next tag
                behind = ends[k + 1] - len(TAG) if k + 1 < len(ends) else len(text)
                stop = text.find("\n", end, behind)
                postfix = parse_expression(text, end, behind if stop < 0 else stop)
                if postfix is None:
                    labels.add("spdx:invalid")
                    places += 1
                    continue
                valid = True
                expressions.append(" ".join(name for _, name in postfix))
                names = [name for kind, name in postfix if kind == "id"]
                labels.update(f"spdx:{name}" for name in names)
                verdict = evaluate(postfix, is_permissive)
                permissive = verdict if permissive is None else permissive and verdict
        got["base_starts"].append(base)
        got["base_labels"].append(sorted(base_labels))
        got["labels"].append(sorted(labels))
        got["expressions"].append(expressions)
        got["permissive"].append(permissive)
        got["score"].append(1.0 if valid else 1.0 - 0.5 ** places)
    return {"n_words": words.counts(), **got}


_TO_SPACE = bytes(i if ALNUM_WORD[i] else 0x20 for i in range(256))
_RUNS = re.compile(" +")


def scan_licenses(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, base_starts (first words of base phrases), base_labels, labels,
    expressions (postfix), permissive (null without an expression) and score."""
    names, number = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    return add_columns(docs, _scan, [
        T.StructField("n_words", T.LongType()), T.StructField("base_starts", number),
        T.StructField("base_labels", names), T.StructField("labels", names),
        T.StructField("expressions", names), T.StructField("permissive", T.BooleanType()),
        T.StructField("score", T.DoubleType())], keep_text, _automata)
