"""Residue against hand-written cases and their look-alikes."""

import re
import re._parser as parser

import heldout
import pytest

from corvane.llm import residue
from corvane.llm.residue import find_residue, inspect, without_residue
from pyspark.sql import functions as F

CASES = {
    "field": ["Welcome to {{project_name}}! Reach us.", "Dear %(first_name)s, hello", "Copyright of [YOUR COMPANY] 2024", "See <project name> for more.", "A scan reads ${api_base_url} twice.", "Text with &lt;team&gt; in it", "{% block title %}{% endblock %} is maintained by us"],
    "default": ["Hello undefined, your answer has NaN of null results.", "Dear [object Object], it is ready.", "owner null, updated NaN/NaN/NaN"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Real words.\n\nTBD TBD TBD", "# Untitled 4\n\nx", "owner: ______", "bla bla bla bla bla", "Hier steht nur Blindtext.", "Posted by  on  in ."],
    "error": ["404 Not Found", "Error 503: try", '{"message":"502 Bad Gateway: sorry","status":502}', "Sorry, the page you asked for could not be found.", "<h1>403 Forbidden</h1><hr><p>You do not have permission to view this resource.</p>", "La page demandée est introuvable.", "Ihre Sitzung ist abgelaufen."],
    "scripts": ["You need to enable JavaScript to run this app.", "<noscript>JavaScript is turned off. Allow it for this site.</noscript>", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Verify that you are human to continue."],
}
CLEAN = [
    None, "", "   \n\t", "Plain words of a commit.", "Tests feed `{{ name }}` and `<%= title %>` to the lexer.", "```html\n<noscript>Please enable JavaScript</noscript>\n{{project_name}}\n```",
    "The function maps a missing page to 404 and a locked one to 403.", "It shows \"page not found\" only in its own tests.", "Our fixture fills the page with lorem ipsum so that layouts wrap.", "The `undefined` value is printed as NaN by the old formatter.",
    "| field | list<float> |", "fn load<T: Into<Name>>(value: T) -> Result<Name, Error> { todo(x) }", "TODO in comments are counted.", "export HOME=${HOME}/bin", "500 readers are moved by the ranker.", "The crawler marks pages whose only body is a request to enable JavaScript.",
]

# Sentences that begin with a word of programming languages.
CASES["field"] += ["If you have questions, contact {{support_email}}.", "For {{customer_name}}: your order is ready.", "Use <project name> to start.", "From {{sender_name}}, with thanks.", "If you have questions (or ideas), see https://x.org or mail {{support_email}}."]
CASES["filler"] += ["Lorem ipsum", "Lorem ipsum dolor", "The hall is open on Monday and has a key for every guest of the house. Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Lorem ipsum dolor sit amet. The hall is open on Monday and has a key for every guest of the house."]
CASES["error"] += ["Sign in to continue.", "Go back to the homepage."]
CLEAN += ["Lorem ipsum is what our fixture fills the page with.", "The word lorem ipsum stands in the test."]
CASES["default"] += ["For undefined, due 00/00/0000: null"]
CLEAN += ["import { Name } from \"x\"", "cd ${project_name}", "git clone <project name>", "if name is None: return None", "return {name}", "for (const name of names) use({name})", "update {table} set name = {name}", "let name: Option<Name>"]


@pytest.mark.parametrize("kind", CASES)
def test_cases(kind):
    for text in CASES[kind]:
        assert kind in {k for k, _, _ in inspect(text)}, text
        assert kind in {k for k, _, _ in inspect("Some real content stands here.\n\n" + text + "\n\nAnd goes on.")}, text


def test_look_alikes():
    for text in CLEAN:
        assert not [x for x in inspect(text) if x[0] not in ("field?", "page?")], text


def test_find_residue(spark, rows):
    texts = [*CLEAN, *(t for group in CASES.values() for t in group)]
    data = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, None, "x"), (len(CLEAN), texts[len(CLEAN)], "x"), (None, "404 Not Found", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, kind string")
    got = find_residue(df, F.col("doc_id"), F.col("text"))
    assert rows(got, "doc_id") == [(i,) for i in range(len(CLEAN), len(texts))]
    assert without_residue(df, "doc_id", "text").where("doc_id is not null").count() == len(CLEAN) + 1
    assert find_residue(df.limit(0), F.col("doc_id"), F.col("text")).count() == 0
    long = spark.createDataFrame([(1, "plain words go on " * 60_000), (2, "plain words go on " * 60_000 + "\nTBD TBD TBD"), (3, "test " * 200_000)], "doc_id long, text string")
    assert rows(find_residue(long, F.col("doc_id"), F.col("text")), "doc_id") == [(2,), (3,)]


def test_names_and_pages_are_settled_over_the_corpus(spark, rows):
    # A name that tells nothing alone is known once the slot of a shared template is filled differently.
    data = [(1, "See {foobarbaz} for the guide."), (2, "See {quxquux} for the guide."), (3, "See {zyzzy} for the guide."), (4, "Alone {zyzzy} stands."), (5, "Nobody fills {unseen} here.")]
    data += [(10, "Blorp 503 error at gate 77"), (11, "Blorp 503 error at gate 78"), (12, "Blorp 502 error at gate 79"), (13, "Single 503 error at door 1")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(find_residue(df, F.col("doc_id"), F.col("text"))) == [(1, ["field"]), (10, ["error"]), (11, ["error"]), (12, ["error"]), (2, ["field"]), (3, ["field"]), (4, ["field"])]


def test_filled_records_show_the_slots(spark, rows):
    # Records with values align with those that kept a name, an unset value or a gap.
    data = [(i, f"Posted by {n} on {i} March.\n\nOwner: {n}\n\nDear {n}, your parcel number {i * 7} waits.\n\nAsk {n} for the key of the hall.\n\n{n}, come in.") for i, n in enumerate(("Anna", "Bertil Berg", "Chloe", "Dmitri"), 1)]
    data += [(11, "Posted by undefined on 3 March."), (12, "Owner: null"), (13, "Dear {foobar}, your parcel number 12 waits."), (14, "Ask  for the key of the hall."), (15, "Dear first_name, your parcel number 4 waits."), (16, "undefined, come in.")]
    data += [(20 + i, f"The result is {w}.") for i, w in enumerate(("null", "empty", "correct", "sorted", "whole"))] + [(30, "Nobody fills undefined here."), (31, "Some {quxquux} alone."), (32, "Ask `x` for the key of the hall.")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(find_residue(df, F.col("doc_id"), F.col("text"))) == [(11, ["default"]), (12, ["default"]), (13, ["field"]), (14, ["default"]), (15, ["field"]), (16, ["default"])]


def test_long_pages_and_pages_without_a_number_recur(spark, rows):
    about = "The gate of the hall keeps a list of visitors for its own peace. "
    block = "Blorp has stopped this visit as suspicious activity came from your network. " + about * 2 + "Tell the site owner and name the line below. Blorp ray id: {}. "
    long = "Gate 503. Your visit was interrupted by gate {}. " + "The visit stays interrupted until the gate opens. " * 9
    data = [(i, block.format(f"7d8f9{i}")) for i in range(3)] + [(10 + i, long.format(i)) for i in range(3)] + [(20 + i, block.format("77") + "Same.") for i in range(3)]
    data += [(30, "Single: " + block.format("1")), *((40 + i, about * 9 + "A request may be rejected; try again with 500 readers.") for i in range(4)), *((50 + i, "Permission is hereby granted in connection with the software.") for i in range(4))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert len(long) > 400
    got = rows(find_residue(df, F.col("doc_id"), F.col("text")), "doc_id")
    assert got == sorted([(i,) for i in (0, 1, 2, 10, 11, 12, 20, 21, 22)], key=repr)


def _examples(pattern):
    """Shortest texts of a parsed pattern: the first of every choice, then each other choice once."""
    out = [""]
    for op, arg in pattern:
        match str(op):
            case "LITERAL":
                some = [chr(arg)]
            case "NOT_LITERAL":
                some = [" "]
            case "IN" if "NEGATE" in str(arg):
                some = [" "]
            case "IN":
                some = [next((chr(a) for o, a in arg if str(o) == "LITERAL"), "5" if "DIGIT" in str(arg) else " " if "SPACE" in str(arg) else "q")]
            case "SUBPATTERN":
                some = _examples(arg[3])
            case "BRANCH":
                some = [x for branch in arg[1] for x in _examples(branch)]
            case "MAX_REPEAT" | "MIN_REPEAT":
                some = [x * max(arg[0], 1) for x in _examples(arg[2])] + ([""] if not arg[0] else [])
            case _:
                some = [""]
        out = [out[0] + x for x in some] + [x + some[0] for x in out[1:]]
    return out


def test_every_saying_has_a_trigger():
    sayings = {"error": residue.ERROR_SAYINGS, "scripts": residue.SCRIPT_SAYINGS, "filler": residue.FILLER_SAYINGS}
    tried = 0
    for kind, patterns in sayings.items():
        for pattern in patterns:
            met = [x for x in _examples(parser.parse(pattern, re.I)) if re.search(pattern, x, re.I)]
            assert met, pattern
            tried += len(met)
            for text in met:
                assert kind in residue._hints(text.lower()), text
    assert tried > 500


def test_unseen_wordings(spark):
    data = heldout.records()
    df = spark.createDataFrame(data, "doc_id long, text string, residue boolean")
    got = {r.doc_id for r in find_residue(df, F.col("doc_id"), F.col("text")).collect()}
    want = {i for i, _, case in data if case}
    assert len(got & want) >= 0.88 * len(want) and len(got & want) >= 0.94 * len(got)
