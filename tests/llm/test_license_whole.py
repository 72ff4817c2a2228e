"""The licence scan's keyword tests let every rule through, with any separators."""

import itertools
import re

from tidemark.llm import license_rules, license_scan


def _strings(nodes):
    """All strings of a parsed pattern of literals, sets, groups, branches and `?`."""
    def one(op, value):
        match str(op):
            case "LITERAL":
                return [chr(value)]
            case "IN":
                return [chr(c) for kind, x in value for c in ([x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1))]
            case "SUBPATTERN":
                return _strings(value[-1])
            case "BRANCH":
                return [x for branch in value[1] for x in _strings(branch)]
            case "MAX_REPEAT":
                return ["", *_strings(value[2])]
        raise ValueError(op)
    return ["".join(x) for x in itertools.product(*(one(*node) for node in nodes))]


def test_license_gate_and_keywords_pass_every_rule():
    """Words between underscores are words; each way to write a name has its rule's keyword."""
    gate = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08X}", license_rules.GATE))
    for label, keyword, words in (*license_rules.BASE, *license_rules.SENTENCES, *license_rules.LICENSES):
        for s in _strings(re._parser.parse(words)):
            assert keyword in s, (label, s)
            assert gate.search(f"_{s.replace(' ', '_')}_") and gate.search(f"x_{s}_x"), (label, s)


def test_license_scan_of_words_between_underscores(spark):
    texts = {1: "_CC BY-NC 4.0_", 2: "__cc by nc__", 3: "img_cc-by-nc.png", 4: "Creative Commons Attribution 4.0", 5: "_cc0_", 6: "Expat license", 7: "acc by nc \u00e9cc0"}
    got = {r.doc_id: (r.n_base, r.first_word, r.base_labels, r.labels) for r in license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    nc = ("cc-by-nc", "cc-by-nc")
    assert got == {1: (1, 0, *nc), 2: (1, 0, *nc), 3: (1, 1, *nc), 4: (0, None, "", "cc-by"), 5: (0, None, "", "cc0-1"), 6: (0, None, "", "mit"), 7: (0, None, "", "")}
