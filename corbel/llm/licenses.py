"""Licence detection by ordered signature rules.

The keywords of all rules are sought at once by an Aho-Corasick automaton;
only rules whose keywords are all there are tried. Keywords that a rule's
pattern doesn't imply are replaced by what it implies. Matches are
accepted by class, then the longer, the earlier and the one whose rule comes
first; a match whose interval is inside, around or across an accepted one is
suppressed.
"""

import re
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .common import texts, worker_cache
from .license_rules import RULES

#: Classes by rank. An SPDX tag states the licence exactly; a name may be a mere mention.
RANK = {"tag": 5, "text": 4, "notice": 3, "url": 2, "title": 2, "name": 1}
GAP = r"(?:[\s/*#;>|]+)"
SPDX = ("*", "tag", ("spdx-license-identifier",), r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?:[ \t]+(?:OR|AND|WITH)[ \t]+[A-Za-z0-9.+-]+)*)\)?")


def rules() -> list[tuple[str, str, tuple[str, ...], str]]:
    """(licence, class, keywords, pattern) in order; licence * is the pattern's first group."""
    out = [SPDX]
    for line in RULES.strip().splitlines():
        name, kind, keys, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((name, kind, tuple(keys.split("+")), flexible(pattern)))
    return out


def flexible(pattern: str) -> str:
    """pattern with each blank for white space and comment marks; in a character class for white space."""
    out, inside = [], False
    for i, c in enumerate(pattern):
        escaped = i and pattern[i - 1] == "\\"
        if c == "[" and not escaped:
            inside = True
        elif c == "]" and not escaped:
            inside = False
        out.append((r"\s" if inside else GAP) if c == " " else c)
    return "".join(out)


def implied(tree) -> list[frozenset[str]]:
    """Sets of strings in small letters; of each set one is in every match of the parsed pattern."""
    out, run = [], ""
    for op, arg in [*tree, (C.ANY, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if op is C.AT:
            continue
        if run:
            out.append(frozenset([run]))
            run = ""
        if op is C.SUBPATTERN:
            out += implied(arg[3])
        elif op is C.MAX_REPEAT and arg[0] > 0 or op is C.MIN_REPEAT and arg[0] > 0:
            out += implied(arg[2])
        elif op is C.BRANCH:
            each = [max(implied(x), key=weight, default=None) for x in arg[1]]
            if None not in each:
                out.append(frozenset().union(*each))
    return out


def weight(alternatives: frozenset[str]) -> int:
    return min(map(len, alternatives))


def needed(keys: tuple[str, ...], pattern: str) -> list[frozenset[str]]:
    """Sets of keywords of which one each must be in a text that the pattern matches: keys where the pattern
    implies them all, else all that it implies."""
    sure = implied(_parser.parse(pattern, re.I))
    if all(any(all(k in x for x in one) for one in sure) for k in keys):
        return [frozenset([k]) for k in keys]
    return sure


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = [(name, kind, re.compile(pattern, re.I | (re.S if ".{" in pattern else 0))) for name, kind, _, pattern in rules()]
        wanted = [needed(keys, pattern) for _, _, keys, pattern in rules()]
        words = sorted({k for sets in wanted for one in sets for k in one})
        number = {w: i for i, w in enumerate(words)}
        self.needs = [[frozenset(number[k] for k in one) for one in sets] for sets in wanted]
        self.automaton = ahocorasick.Automaton()
        for w, i in number.items():
            self.automaton.add_word(w, i)
        self.automaton.make_automaton()
        self.by_first: dict[int, list[int]] = {}
        for i, sets in enumerate(wanted):
            for k in max(sets, key=weight):
                self.by_first.setdefault(number[k], []).append(i)

    def scan(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, licence, rule number) of the detections that remain, in order of the text."""
        hits = {i for _, i in self.automaton.iter(text.lower())}
        found = []
        for rule in sorted({r for h in hits for r in self.by_first.get(h, ())}):
            if all(one & hits for one in self.needs[rule]):
                name, kind, pattern = self.rules[rule]
                for m in pattern.finditer(text):
                    found.append((-RANK[kind], m.start() - m.end(), m.start(), rule, m.end(), m[1] if name == "*" else name))
        kept: list[tuple[int, int, str, int]] = []
        for _, _, start, rule, end, name in sorted(found):
            if all(end <= a or b <= start for a, b, *_ in kept):
                kept.append((start, end, name, rule))
        return sorted(kept)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, license, kind, rule) of each detection, with character offsets; rule numbers the signature.

    Null and empty texts and texts without a licence give no row, nor do rows
    without doc_id; rows that repeat a doc_id each give theirs. An empty table
    gives no rows. Columns besides doc_id and text aren't read. No shuffle is made.
    """

    def run(batches):
        s = worker_cache("licenses", Scanner)
        for batch in batches:
            for part in K.slices(batch):
                out = [(i, *d) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for d in s.scan(text)]
                if not out:
                    continue
                ids, start, end, name, rule = zip(*out)
                kind = [s.rules[r][1] for r in rule]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(start), pa.array(end), pa.array(name), pa.array(kind), pa.array(rule, pa.int32())], ["doc_id", "start", "end", "license", "kind", "rule"])

    return texts(docs).mapInArrow(run, "doc_id long, start long, end long, license string, kind string, rule int")
