import random

from rohspark.operators import record_parse as rp

L = "file_id bigint, line_no int, raw_line string, chr string, status string"
F = "file_id bigint, file_kind string, file_name string, panel_id int, n_ind int"
FILES = [(1, "tped", "a", 1, 2), (2, "centromere", "b", 1, None), (3, "tped", "c", 1, None)]


def status(line, kind="tped", n=2):
    got = rp.parse_line(kind, n, line)
    return got[0], got[1]


def test_valid_lines():
    for line in ("chr1 rs1 0.5 100 A C G 0", "\t1\trs:1.x-_\t1e-3\t1 A A A A\r", '"X" "rs1" "1" "2147483647" "A" A A A', "chrUn_0001 ab12 5.25E+2 0000000001 0 0 0 0 \r\n"[:-1]):
        assert status(line)[0] == "valid", line
    assert status('"chr7" 5 9', "centromere")[0] == "valid"


def test_skipped():
    assert {status(x)[0] for x in ("", " \t\r", "# x", " \t#", None)} == {"skipped"}


def test_failures_and_reasons():
    cases = {
        "chr1 rs1 0.5 100 A C G": "7 fields instead of 8",
        "chr01 rs1 0.5 100 A C G T": "chr is unknown",
        "chr23 rs1 0.5 100 A C G T": "chr is unknown",
        "chrchr1 rs1 0.5 100 A C G T": "chr is unknown",
        "Chr1 rs1 0.5 100 A C G T": "chr is unknown",
        "chr1 1rs 0.5 100 A C G T": "locus name is malformed",
        "chr1 rsx 0.5 100 A C G T": "locus name is malformed",
        "chr1 r" + "1" * 24 + " 0.5 100 A C G T": "locus name is malformed",
        "chr1 rs1 -0.5 100 A C G T": "gpos is no number",
        "chr1 rs1 .5 100 A C G T": "gpos is no number",
        "chr1 rs1 5. 100 A C G T": "gpos is no number",
        "chr1 rs1 0.5 0 A C G T": "ppos is no position",
        "chr1 rs1 0.5 2147483648 A C G T": "ppos is no position",
        "chr1 rs1 0.5 ١٢ A C G T": "ppos is no position",
        "chr1 rs1 0.5 100 a C G T": "allele is none of A C G T 0",
        'chr1 rs1 0.5 100 A C G "T': "unclosed quote",
        'chr1 rs1 0.5 100 A C G T"': "quote inside a field",
        'chr1 "rs1"x 0.5 100 A C G T': "text behind a closing quote",
        'chr1 "rs 1" 0.5 100 A C G T': "locus name is malformed",
        'chr1 rs1 0.5 100 "" C G T': "allele is none of A C G T 0",
        "chr1 rs1 0.5 100 A C G T": "7 fields instead of 8",
        "chr1 rs1 0.5 100 A C G T\n": "allele is none of A C G T 0",
    }
    for line, reason in cases.items():
        assert status(line) == ("failed", reason), line
    assert status("chr1 5 5", "centromere") == ("failed", "start is not below end")
    assert status("chr1 5 4 6", "centromere")[1] == "4 fields instead of 3"
    assert status("chr1 5 6", None)[1] == "file is not described"


def test_errors_are_located_and_the_parser_goes_on():
    got = rp.parse_line("tped", 2, 'chr1 "rs1 0.5 100 A C G T chr2 rs2 0.1 5 A A A A')
    errors = got[5]
    assert errors[0] == {"reason": "unclosed quote", "field": 1, "col": 5}
    p = rp.LineParser('chr1 "rs1 0.5 100 A C G T chr2 rs2 0.1')
    assert p.record()[2:5] == ["chr2", "rs2", "0.1"]  # resumed at the next record start
    assert [e["col"] for e in rp.parse_line("tped", 2, "chr1 rs1 x 0 A C G T")[5]] == [9, 11]


def test_tables(spark):
    lines = [(1, 1, "chr1 rs1 0.5 100 A C G 0", "x", "y"), (1, 2, "bad", "x", "y"), (1, 3, None, "x", "y"), (1, 4, "#", "x", "y"), (1, 2, "bad", "x", "y"), (3, 1, "1 rs1 1 1", "x", "y"), (None, 1, "bad", "x", "y"), (9, 1, "1 rs1 1 1", "x", "y"), (2, 1, "1 2 3", "x", "y"), (1, 9, "A " * 200_000, "x", "y")]
    out = rp.parse_lines(spark.createDataFrame(lines, L), spark.createDataFrame(FILES, F), "tped")
    by = {}
    for r in out.collect():
        by.setdefault((r["file_id"], r["line_no"]), []).append((r["status"], r["chr"], r["ppos"], r["reason"]))
    assert by[(1, 1)] == [("valid", "chr1", 100, None)] and len(by[(1, 2)]) == 2 and by[(1, 3)][0][0] == by[(1, 4)][0][0] == "skipped"
    assert {by[k][0][3] for k in ((3, 1), (None, 1), (9, 1), (2, 1))} == {"file is not described"}
    assert by[(1, 9)][0][3] == "200000 fields instead of 8"
    assert rp.valid_rows(out, "tped").columns == ["file_id", "line_no", "chr", "locus_name", "gpos", "ppos", "alleles"]
    assert rp.failed_rows(out).count() == 7
    assert rp.parse_lines(spark.createDataFrame([], L), spark.createDataFrame(FILES, F), "tped").count() == 0
    assert rp.parse_lines(spark.createDataFrame(lines, L), spark.createDataFrame([], F), "centromere").where("status = 'failed'").count() == 8


def test_round_trip_of_random_records():
    r = random.Random(2)
    for _ in range(300):
        fields = [r.choice(["chr", ""]) + r.choice(["1", "22", "X"]), "rs" + str(r.randrange(10**6)), f"{r.random():.4f}", str(r.randrange(1, 10**9)), *(r.choice("ACGT0") for _ in range(4))]
        line = "".join((f'"{f}"' if r.random() < 0.2 else f) + r.choice([" ", "\t", " \t", "\r "]) for f in fields)
        got = rp.parse_line("tped", 2, line)
        assert got[0] == "valid" and got[7] == fields[1] and got[9] == int(fields[3]) and got[12] == fields[4:]


def test_records_behind_an_anchor_come_out(spark):
    line = 'chr1 "rs1 0.5 100 A C G T chr2 rs2 0.1 5 A A A A'
    parsed = rp.parse_lines(spark.createDataFrame([(1, 1, line, "", "")], L), spark.createDataFrame(FILES, F), "tped")
    assert [tuple(r) for r in rp.recovered_rows(parsed, "tped").collect()] == [(1, 1, line.index("chr2"), "chr2", "rs2", 0.1, 5, ["A"] * 4)]
    assert rp.failed_rows(parsed).count() == 1 and rp.valid_rows(parsed, "tped").count() == 0
    assert [e["reason"] for e in rp.parse_line("tped", 2, "chr99 rs1 0.5 0 A C G")[5]] == ["7 fields instead of 8", "chr is unknown", "ppos is no position"]
