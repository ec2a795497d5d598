"""Routing of chunks to the parts of their notes."""

from tidewell.operators import routing

NOTE = """# Reflections

## Core Identity
### hermes inside the core
- x

## Preferences & Opinions
- y

## Active Projects

### hermes-agent
- gateway

### om-relay / health
- up

## Archive
### widget.factory
- old

## Recent Themes
- theme
"""
PLAIN = "## Core Identity\n- x\n## One\n- 1\n## Two\n- 2\n"


def _routed(spark, *texts, fold=0):
    rows = [("n", i, fold + i, t) for i, t in enumerate(texts)]
    notes = spark.createDataFrame([("n", NOTE), ("m", PLAIN), ("e", None)], "doc string, text string")
    found = routing.routed(spark.createDataFrame(rows, "doc string, chunk_id int, fold int, text string"), notes)
    return sorted(found.collect(), key=lambda r: r.chunk_id), routing.contexts(found, notes)


def test_names_sections_and_themes(spark):
    got, _ = _routed(spark, "Spent it on hermes, then the RELAY.", "see Archive of factory", "working", "hermes-agent/x", "about recent-themes and core-identity")
    always = ["ref:core-identity", "ref:preferences-opinions"]
    assert [r.sections for r in got] == [always, [*always, "ref:archive"], [*always, "ref:recent-themes"], always, [*always, "ref:recent-themes"]]
    assert [r.subsections for r in got] == [["ref:active-projects:hermes-agent", "ref:active-projects:om-relay-health"], ["ref:archive:widget-factory"], [], ["ref:active-projects:hermes-agent"], []]
    assert not any(r.rotation for r in got)
    assert got[0].unmatched == ["spent", "the", "then"] and got[3].unmatched == ["hermes-agent-x"]


def test_rotation_goes_round_the_subsections(spark):
    got, _ = _routed(spark, "zeta-service", None, "", "zeta", fold=1)
    assert [r.subsections for r in got] == [["ref:active-projects:om-relay-health"], ["ref:archive:widget-factory"], ["ref:active-projects:hermes-agent"], ["ref:active-projects:om-relay-health"]]
    assert all(r.rotation for r in got) and got[0].unmatched == ["service", "zeta", "zeta-service"] and got[1].unmatched == []


def test_notes_without_subsections_empty_and_unknown(spark):
    rows = [("m", 0, 0, "zeta"), ("m", 1, 3, "zeta"), ("e", 0, 0, "zeta today"), ("?", 0, 0, "zeta"), (None, 0, 0, "zeta")]
    notes = spark.createDataFrame([("m", PLAIN), ("e", None)], "doc string, text string")
    got = {(r.doc, r.chunk_id): (r.sections, r.subsections, r.rotation) for r in routing.routed(spark.createDataFrame(rows, "doc string, chunk_id int, fold int, text string"), notes).collect()}
    assert got == {
        ("m", 0): (["ref:core-identity", "ref:one"], [], True), ("m", 1): (["ref:core-identity", "ref:two"], [], True),
        ("e", 0): ([], [], True), ("?", 0): ([], [], True), (None, 0): ([], [], True),
    }


def test_context_of_a_route(spark):
    _, contexts = _routed(spark, "factory, archive")
    assert contexts.first().text == (
        "## Core Identity\n### hermes inside the core\n- x\n\n## Preferences & Opinions\n- y\n\n## Archive\n### widget.factory\n- old\n\n## Archive\n\n### widget.factory\n- old"
    )


def test_a_text_is_read_once_and_not_once_a_name(spark):
    chunks = spark.createDataFrame([("n", 0, 0, "a working text")], "doc string, chunk_id int, fold int, text string")
    plan = routing.routed(chunks, spark.createDataFrame([("n", NOTE)], "doc string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(_tokens")]
    assert "in progress" in plan and "in progress" not in above  # the look for current work stands below the rows of names
