"""A rule runs only behind its keyword, so each way to match must contain it."""

import re
from itertools import product

import pytest

from pagelathe.llm import licenses
from pagelathe.llm.license_rules import ordered

parser, names = re._parser, re._constants


def ways(parsed):
    """The shortest texts of every choice of alternatives; what is optional is left out."""
    parts = []
    for op, arg in parsed:
        if op is names.LITERAL:
            parts.append([chr(arg)])
        elif op is names.SUBPATTERN:
            parts.append(ways(arg[-1]))
        elif op is names.BRANCH:
            parts.append([w for x in arg[1] for w in ways(x)])
        elif op in (names.MAX_REPEAT, names.MIN_REPEAT):
            parts.append(["".join(x) for x in product(ways(arg[2]), repeat=arg[0])])
        elif op is names.IN:
            parts.append(["0"])
        elif op is names.ANY:
            parts.append(["x"])
        else:
            raise AssertionError(op)
    return ["".join(x) for x in product(*parts)]


@pytest.mark.parametrize("rule", ordered(), ids=lambda r: f"{r[0]}: {r[2]}")
def test_keyword_is_in_every_way(rule):
    _, _, key, pattern = rule
    for way in ways(parser.parse(pattern)):
        assert key in way
        word = max(key.split(" "), key=len)
        assert word not in licenses.WHOLE or word in way.split(" ")


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"),
        ("Licensed under Creative Commons Attribution NonCommercial NoDerivatives 4.0", "cc-by-nc-nd"),
        ("under BSL-1.0 only", "boost-1.0"),
        ("community data license agreement - permissive", "cdla"),
        ("the End-User Licence Agreement", "eula"),
    ],
)
def test_spelled_out_names(spark, text, label):
    assert label in licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["labels"].split(",")
