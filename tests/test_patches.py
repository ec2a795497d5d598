"""Section patches: the envelope, what fits a note, and that every fault leaves the note as it was."""

import pytest

from tidewell.operators import patches

NOTE = (
    "# Reflections\n\n*Last updated: x*\n<!--om: doc=r-->\n\n## Core Identity\n\n- Ana\n\n## Active Projects\n\nintro\n\n### Tide Well\n\n- one\n\n### Other\n\n- two\n\n"
    "## Notes\n- a\n### Detail\n- b\n### Detail\n- c\n## Notes\n#### deep\n- d\n"
)


def block(handle, body, *more):
    return "\n".join([f"SECTION_HANDLE: {handle}", *more, "UPDATED_MARKDOWN:", body, ""])


CORE = block("ref:core-identity", "## Core Identity\n- Bo")
GOOD = {
    "section": (CORE, NOTE.replace("## Core Identity\n\n- Ana\n\n", "## Core Identity\n- Bo\n\n")),
    "spaces around marks": ("\n  \nSECTION_HANDLE: \t ref:core-identity \t\nUPDATED_MARKDOWN: \t\n\n\n## Core Identity\n- Bo\n\n\n", NOTE.replace("## Core Identity\n\n- Ana\n\n", "## Core Identity\n- Bo\n\n")),
    "subsection": (block("ref:active-projects:tide-well", "### Tide Well\n- new"), NOTE.replace("### Tide Well\n\n- one\n\n", "### Tide Well\n- new\n\n")),
    "last subsection": (block("ref:active-projects:other", "### Other\n- new"), NOTE.replace("### Other\n\n- two\n\n", "### Other\n- new\n")),
    "second of a name": (block("ref:notes:detail-2", "### Detail\n- C"), NOTE.replace("- c\n", "- C\n")),
    "second section of a name": (block("ref:notes-2", "## Notes\n- D"), NOTE.replace("## Notes\n#### deep\n- d\n", "## Notes\n- D\n\n")),
    "two siblings": (
        block("ref:active-projects:other", "### Other\n- 2") + block("ref:active-projects:tide-well", "### Tide Well\n- 1"),
        NOTE.replace("### Tide Well\n\n- one\n\n### Other\n\n- two\n\n", "### Tide Well\n- 1\n\n### Other\n- 2\n"),
    ),
    "added after a section": (block("ref:new", "## New\n- n", "NEW_AFTER: ref:notes"), NOTE.replace("- c\n## Notes", "- c\n\n## New\n- n\n\n## Notes")),
    "added at the end": (block("ref:new", "## New\n- n", "NEW_AFTER:"), NOTE + "\n## New\n- n\n\n"),
    "changed and added to": (
        CORE + block("ref:n1", "## N1\n- n", "NEW_AFTER: ref:core-identity") + block("ref:n2", "## N2\n- n", "NEW_AFTER: ref:core-identity"),
        NOTE.replace("## Core Identity\n\n- Ana\n\n", "## Core Identity\n- Bo\n\n## N1\n- n\n\n## N2\n- n\n\n"),
    ),
    "a line like a handle's in the body": (
        block("ref:core-identity", "## Core Identity\n- x\nSECTION_HANDLE: y\n- z"),
        NOTE.replace("## Core Identity\n\n- Ana\n\n", "## Core Identity\n- x\nSECTION_HANDLE: y\n- z\n\n"),
    ),
}
BAD = {
    "empty reply": " \n\t ",
    "no section handle": "nothing to change",
    "text before the first block": "Sure:\n" + CORE,
    "empty handle": block("", "## A\n- x"),
    "no markdown line": "SECTION_HANDLE: ref:core-identity\n## Core Identity\n- x",
    "empty markdown": "SECTION_HANDLE: ref:core-identity\nUPDATED_MARKDOWN:\n\n \n",
    "not one heading": block("ref:core-identity", "## Core Identity\n- x\n\n## Smuggled\n- y"),
    "not one heading ": block("ref:core-identity", "- no heading"),
    "not one heading  ": block("ref:active-projects:other", "## Wrong level\n- x"),
    "text before the heading": block("ref:core-identity", "- x\n## Core Identity"),
    "section inside a subsection": block("ref:active-projects:other", "### Other\n## In\n- x"),
    "repeated handle": CORE + CORE,
    "unknown handle": CORE + block("ref:nope", "## Nope\n- x"),
    "unknown handle ": block("ref:active-projects:nope", "### Nope\n- x"),
    "unknown place": block("ref:new", "## New\n- x", "NEW_AFTER: ref:nope"),
    "heading exists": block("ref:new", "## Active Projects\n- x", "NEW_AFTER:"),
    "heading exists ": block("ref:n1", "## New\n- x", "NEW_AFTER:") + block("ref:n2", "## new!\n- y", "NEW_AFTER:"),
    "new handle exists": block("ref:core-identity", "## Fresh\n- x", "NEW_AFTER:"),
    "section and subsection": block("ref:active-projects", "## Active Projects\n### Tide well\n### other") + block("ref:active-projects:other", "### Other\n- x"),
    "lost subsections": block("ref:active-projects", "## Active Projects\n### Tide Well\n- x"),
    "handle not offered": block("ref:notes", "## Notes\n### Detail\n- x\n### Detail 2\n- x"),
}


@pytest.fixture(scope="module")
def outcomes(spark):
    cases = {**{k: v[0] for k, v in GOOD.items()}, **BAD, "none": None}
    docs = spark.createDataFrame([(k, NOTE) for k in [*cases, "twice"]], "doc string, text string")
    replies = [(k, v) for k, v in cases.items() if k != "none"] + [("twice", CORE), ("twice", CORE)]
    offered = patches.note_parts(docs).filter("handle <> 'ref:notes'").select("doc", "handle")
    done = patches.applied(docs, spark.createDataFrame(replies, "doc string, reply string"), offered)
    return {r.doc: r for r in done.collect()}


@pytest.mark.parametrize("case", GOOD)
def test_what_fits_is_put_in(outcomes, case):
    assert (outcomes[case].error, outcomes[case].text) == (None, GOOD[case][1])


@pytest.mark.parametrize("case", BAD)
def test_faults_change_nothing(outcomes, case):
    assert (outcomes[case].error, outcomes[case].text) == (case.strip(), NOTE)


def test_no_reply_and_two_replies(outcomes):
    assert outcomes["none"].error is None and outcomes["twice"].error == "several replies"
    assert outcomes["none"].text == outcomes["twice"].text == NOTE


def test_handles(spark):
    found = patches.note_parts(spark.createDataFrame([(1, NOTE), (2, "## \n##x\n### y"), (3, None), (4, "## ###\n## é")], "doc long, text string"))
    got = {d: [r.handle for r in found.filter(f"doc = {d}").orderBy("ord", "sub").collect()] for d in (1, 2, 3, 4)}
    own = ["ref:core-identity", "ref:active-projects", "ref:active-projects:tide-well", "ref:active-projects:other", "ref:notes", "ref:notes:detail", "ref:notes:detail-2", "ref:notes-2"]
    assert got == {1: [None, *own], 2: [None], 3: [None], 4: [None, "ref:section"]}


@pytest.mark.parametrize("text", ["", "x", "# T\r\n\r\n## A\r\nb\r\n\r\n## B", "## A\n\n\n## A\n### s\n", "a\n##no\n## Y  \n\x0b\n", "## A\u2028## B\n### C\x85### D"])
def test_parts_hold_every_byte(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc long, text string")
    assert patches.applied(docs, docs.limit(0).select("doc", docs.text.alias("reply"))).collect()[0].text == text


def test_an_empty_note_takes_an_addition(spark):
    docs = spark.createDataFrame([(1, ""), (2, None)], "doc long, text string")
    replies = spark.createDataFrame([(1, block("ref:new", "## New\n- n", "NEW_AFTER:")), (2, CORE)], "doc long, reply string")
    got = {r.doc: (r.text, r.error) for r in patches.applied(docs, replies).collect()}
    assert got == {1: ("## New\n- n\n\n", None), 2: ("", "unknown handle")}


def test_parts_of_a_note_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, NOTE)], "doc long, text string")
    plan = patches.note_parts(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
