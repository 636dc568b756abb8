from codestrata.operators import syntax

LONG = "\n".join(['$a0 = $_GET["q"];', *(f"$a{k + 1} = $a{k};" for k in range(12)), "$a3 = $a12;", "echo $a12;"])


def test_long_chains_and_cycles_are_followed_to_their_end(spark):
    files = spark.createDataFrame([("/long.php", "php", LONG), ("/clean.php", "php", "$x = $y;\n$y = $x;\necho $x;")], "path string, language string, content string")
    lines = syntax.source_lines(files, "php")
    found = {(r["path"], r["variable"]): r["steps"] for r in syntax.tainted_variables(syntax.assignments(lines)).collect()}
    assert found == {("/long.php", f"a{k}"): k for k in range(13)}
    assert {(r["variable"], r["sink_line"], r["steps"]) for r in syntax.taint_paths(lines).collect()} == {("a12", 15, 12)}
    assert ("XSS-001", "/long.php", 15) in {(r["rule_id"], r["path"], r["line"]) for r in syntax.rule_findings(lines).collect()}


def test_the_line_that_took_the_input_in_and_the_way_from_it(spark):
    text = '$other = $_GET["o"];\n$far = $other;\n$clean = 1;\n$near = $_POST["n"];\n$x = $far;\n$x = $near;\necho $x;\n$near = $x;\nprint $other;'
    lines = syntax.source_lines(spark.createDataFrame([("/a.php", "php", text)], "path string, language string, content string"), "php")
    found = {(r["variable"], r["sink_line"]): (r["source_line"], r["steps"], list(r["trail"])) for r in syntax.taint_paths(lines).collect()}
    assert found == {("x", 7): (4, 1, [4, 6]), ("other", 9): (1, 0, [1])}


def test_a_thousand_steps_take_no_rounds(spark):
    text = "\n".join(['$a0 = $_GET["q"];', *(f"$a{k + 1} = $a{k};" for k in range(1000)), "echo $a1000;"])
    lines = syntax.source_lines(spark.createDataFrame([("/a.php", "php", text)], "path string, language string, content string"), "php")
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None) or [])
    (r,) = syntax.taint_paths(lines).collect()
    assert (r["source_line"], r["sink_line"], r["steps"], list(r["trail"])) == (1, 1002, 1000, list(range(1, 1002)))
    assert len(jobs.getJobIdsForGroup(None) or []) - before < 8
