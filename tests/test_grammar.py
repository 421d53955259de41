"""Grammar membership on a small grammar."""

import pytest

from stavelake.operators import grammar

SOURCE = r'''
# a score
root ::= clef nl (line nl)* end
clef ::= "*clef" [FG] [1-5]   # one clef
line ::= note (tab note)* | "=" {1,2}
note ::= [0-9]+ "."? ([a-g]+ | "r") ("#" | "-")?
end ::= "*-"
tab ::= "\t"
nl ::= "\n"
'''


def test_membership(spark):
    cases = [("*clefG2\n4c\t8dd#\n==\n*-", (True, None, None)), ("*clefG2\n4c\t8x\n*-", (False, 2, 5)), ("*clefG2\n4c\n", (False, 3, 1)), ("", (False, 1, 1)), (None, (False, 1, 1)), ("*clefG2\n===\n*-", (False, 2, 3))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    got = {r.doc_id: (r.g.belongs, r.g.line, r.g.col) for r in docs.select("doc_id", grammar.grammar_column("text", SOURCE).alias("g")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_errors():
    for source, said in (('root ::= "a" root?', "uses itself"), ("root ::= other", "Unknown"), ('root ::= "a" %', "Cannot read"), ('"a"', "start")):
        with pytest.raises(ValueError, match=said):
            grammar.to_pattern(source)
