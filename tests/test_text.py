"""Cleaning, packing, quotes and findings."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import clean as C
from vellum.operators import extract as E
from vellum.operators.stem import stem

PROSE = "The participants were recruited from a clinic and they slept well in the weeks after the first visit to the centre of the city."


def cleaned(*paragraphs):
    return C.blocks_of("\n\n".join(paragraphs))


def test_front_matter_goes():
    blocks, _ = C.blocks_of(f"front\n\n\x9f=====\x9f\n\n{PROSE}")
    assert [b[2] for b in blocks] == [PROSE]


def test_structured_abstract():
    blocks, _ = cleaned("Background", PROSE, "Methods", PROSE, "INTRODUCTION", PROSE, "METHODS", PROSE)
    assert [b[0] for b in blocks] == ["abstract", "abstract", "introduction", "methods"]


def test_subsections_inherit():
    long = " ".join([PROSE] * 25)
    blocks, _ = cleaned(long, "2. Materials and Methods", PROSE, "2.1.3. Outcomes", PROSE, "Survey Data", PROSE)
    assert [b[0] for b in blocks] == ["abstract", "methods", "methods", "methods"]
    assert [b[1] for b in blocks][-2:] == ["2.1.3. Outcomes", "Survey Data"]


def test_boilerplate_and_appendix():
    blocks, dropped = cleaned("Conclusion", PROSE, "Ethics approval", PROSE, "References", PROSE)
    assert len(blocks) == 1 and dropped["boilerplate_section"] == 2 and dropped["boilerplate_block"] == 2
    blocks, dropped = cleaned(PROSE, "Decision letter", PROSE)
    assert len(blocks) == 1 and dropped["appendix_truncated"] == 1


def test_references_tables_strategies():
    ref = "1. Smith J, Jones K. A long citation that goes on for more than sixty characters. 2019."
    assert cleaned(ref)[1]["reference_block"] == 1
    found, dropped = cleaned("a\tb\tc\nd\te\tf")
    assert not found and dropped["table_line"] == 2 and dropped["table_block"] == 1
    mixed = f"{PROSE} (sleep[Title/Abstract] OR rest[MeSH Terms])."
    assert cleaned(mixed)[0][0][2] == PROSE
    assert cleaned("Sleep[tiab] OR rest[tiab] OR pain[tiab] or other words here and there.")[1]["search_strategy"] == 1
    assert "documentclass" not in cleaned(PROSE + r" \documentclass{x} y \end{document} " + PROSE)[0][0][2]
    assert not C.reads_as_prose("( ) yes ( ) no [ ] maybe ( ) never")


@pytest.mark.parametrize(("title", "kind"), [("Methods", ("section", "methods")), ("IV. Results:", ("section", "results")), ("Funding for the study", ("boilerplate", None)), ("Supplementary analyses", ("section", None)), ("2.1. Data", ("subsection", None)), ("This ends with a stop.", ("text", None)), ("Reviewer #2", ("appendix", None))])
def test_titles(title, kind):
    assert C.title_kind(title) == kind


def test_packing():
    words = " ".join(["the", "word"] * 30)
    assert [p[4] for p in C.passages([("methods", None, words)] * 6, 200, 260, 25)] == [240, 120]
    sentences = " ".join("The " + " ".join(f"w{i}x{j}" for j in range(50)) + "." for i in range(8))
    assert sum(len(p.split()) for p in C.pieces(sentences, 210)) == len(sentences.split())
    assert max(len(p.split()) for p in C.pieces(" ".join(["w"] * 500), 210)) == 210
    assert [p[1] for p in C.passages([("methods", "a", words), ("results", "b", words)], 200, 260, 25)] == ["methods", "results"]
    assert C.passages([("methods", None, "too short")], 200, 260, 25) == []
    assert C.budget() == (189, 248, 25) and C.budget(350)[2] == 25


def test_columns_agree_with_python(spark):
    titles = ["2. Methods:", "IV. Aims", "Supplementary data", "a b c.", "3.1. Outcomes", PROSE, "x\ty", "Data availability statement"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    t = F.col("t")
    for r in df.select("t", T.is_heading(t).alias("h"), T.strip_numbering(t).alias("s"), T.is_subsection(t).alias("sub"), T.is_prose(t).alias("p"), T.canonical_section(t).alias("c"), T.is_boilerplate(t).alias("b")).collect():
        kind, name = C.title_kind(r["t"])
        assert r["h"] == (kind != "text") and r["s"] == C.bare_title(r["t"]) and r["p"] == C.reads_as_prose(r["t"])
        assert r["sub"] == bool(C.Grammar.subsection.match(r["t"]))
        if kind == "section":
            assert r["c"] == name
        assert r["b"] == (kind == "boilerplate")


def test_clean_and_chunk_frames(spark):
    df = spark.createDataFrame([(1, f"Methods\n\n{PROSE}\n\n{PROSE}"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in C.clean(df).collect()}
    assert len(rows[1]["blocks"]) == 2 and rows[2]["blocks"] == []
    assert [r["n_words"] for r in C.chunk(df).collect()] == [2 * len(PROSE.split())]


def test_locate():
    text = "He said “it works” and\nleft — at once."
    assert E.locate(text, 'said "it works" and left - at') == (3, 32)
    assert E.locate(text, "works") == (12, 17) and E.locate(text, "absent") is None and E.locate(text, " ") == (2, 3)
    assert E.locate("ﬁnd it", "find") == (0, 3)


def test_locate_against_all_spans():
    rng = random.Random(5)
    plain = lambda x: re.sub(r"\s+", " ", x.translate(E.PLAIN))
    letters = ["a", "f", "i", "l", "ﬁ", "ﬂ", " ", "  ", "\n", "–", "-", "’", "'", "“"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        quote = "".join(rng.choices(letters, k=rng.randint(1, 4)))
        got = E.locate(text, quote)
        if quote in text:
            assert got == (text.find(quote), text.find(quote) + len(quote))
            continue
        wanted = plain(quote.strip())
        holds = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if wanted and wanted in plain(text[i:j])]
        assert (got is None) == (not holds), (text, quote)
        if got:  # the first match ends first, and its span can't be shortened
            assert got[1] == min(j for _, j in holds)
            assert wanted in plain(text[slice(*got)]) and wanted not in plain(text[got[0] + 1 : got[1]]) and wanted not in plain(text[got[0] : got[1] - 1])


def test_findings():
    passage = {"W1#0": "Sleep improved by five points in the treated group over eight weeks."}
    good = {"claim": "Sleep improved by five points.", "caveats": "small sample", "chunk_id": "W1#0", "quote": "Sleep improved by five points in the treated group"}
    bad = ["text", good | {"claim": "short"}, good | {"caveats": "none"}, good | {"chunk_id": "W9#0"}, good | {"quote": "too short"}, good | {"quote": "Sleep got worse by five points in the treated group"}]
    kept, drops = E.validate("W1", passage, [good, *bad, good])
    assert [d["reason"] for d in drops] == ["not_an_object", "claim_length", "empty_caveats", "unknown_chunk", "quote_length", "quote_not_found", "duplicate_claim"]
    assert kept[0]["char_start"] == 0 and kept[0]["quote"] == good["quote"]
    many = [good | {"claim": f"Sleep improved by {i} points in all."} for i in range(10)]
    assert [d["reason"] for d in E.validate("W1", passage, many)[1]] == ["over_limit"] * 2
    with pytest.raises(ValueError):
        E.parse_reply('[{"paper": 2, "findings": []}]', [("W1", passage)])
    assert E.parse_reply('```json\n[{"paper": 1, "findings": []}]\n```', [("W1", passage)]) == [([], [])]


def test_model_failures_stay_pending(spark):
    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return prompt.upper()

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "batch_id long, prompt string")
    assert {r["batch_id"]: (r["reply"], r["error"]) for r in E.run_model(df, model).collect()} == {1: ("OK", None), 2: (None, "no")}


def test_finding_id_matches_hash(spark):
    df = spark.createDataFrame([("W1", "A  claim\nhere")], "w string, c string")
    assert df.select(T.finding_id(F.col("w"), F.col("c"))).first()[0] == "f_" + hashlib.sha256(b"W1\na claim here").hexdigest()[:16]


@pytest.mark.parametrize(("w", "s"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("sleeping", "sleep"), ("generalization", "gener"), ("adoption", "adopt"), ("happy", "happi"), ("rate", "rate"), ("controlling", "control")])
def test_stem(w, s):
    assert stem(w) == s


def test_markup_and_xml(spark):
    df = spark.createDataFrame([("<h4>Background</h4>one two", "<article><front>no</front><body><sec>Intro <p>First <i>finding</i> .</p></sec></body></article>")], "h string, x string")
    assert tuple(df.select(T.plain(F.col("h")), T.jats_text(F.col("x"))).first()) == ("Background: one two", "Intro First finding .")
