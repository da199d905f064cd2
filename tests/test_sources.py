import json
import random

import pytest
from pyspark.sql import functions as F

from helpers import rows
from sieveline import Options, clean, profile
from sieveline.errors import LoadError, OptionsError, PlanError, ValidationError
from sieveline.sources.csv import read_csv
from sieveline.sources.records import ends_inside, records
from sieveline.sources.sinks import read_options, read_plan, save_run, write_analysis, write_cleaned, write_options, write_table


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_types_and_missing_tokens(spark, tmp_path):
    path = write(tmp_path / "t.csv", "i,gap,x,flag,half_flag,s,day,none\n1,1,1.5,True,True,a,2024-01-05,\n2,NA,n/a,FALSE,null,#N/A,2024-01-06,\n-3,3, 7 ,true,False,NaN b,x,NaN\n")
    df = read_csv(spark, path)
    assert dict(df.dtypes) == {"i": "bigint", "gap": "double", "x": "double", "flag": "boolean", "half_flag": "string",
                               "s": "string", "day": "string", "none": "double"}
    assert [tuple(r) for r in df.orderBy("i").collect()][0] == (-3, 3.0, 7.0, True, "False", "NaN b", "x", None)
    assert df.where("s IS NULL").count() == 1 and df.where("gap IS NULL").count() == 1


def test_quotes_and_embedded_newlines(spark, tmp_path):
    path = write(tmp_path / "q.csv", 'a,b\n1,"x\ny, ""z"""\n2,plain\n')
    assert rows(read_csv(spark, path)) == [(1, 'x\ny, "z"'), (2, "plain")]


def test_header_names_are_made_unique(spark, tmp_path):
    assert read_csv(spark, write(tmp_path / "h.csv", "a,a,,b\n1,2,3,4\n")).columns == ["a", "a.1", "Unnamed: 2", "b"]


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "folder.csv"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,x\n")
    write(folder / "2.csv", "a,b\n2,y\n")
    assert rows(read_csv(spark, str(folder))) == [(1, "x"), (2, "y")]
    write(folder / "3.csv", "b,a\ny,2\n")
    with pytest.raises(LoadError, match="headers"):
        read_csv(spark, str(folder))


def test_delimiter_and_encoding(spark, tmp_path):
    path = write(tmp_path / "l.tsv", "n;name\n1;é\n2;b\n3;c\n", "latin-1")
    df = read_csv(spark, path, encoding="iso-8859-1", delimiter=";")
    assert rows(df) == [(1, "é"), (2, "b"), (3, "c")]
    with pytest.raises(LoadError, match="not valid"):
        read_csv(spark, path, delimiter=";")


def test_short_rows_are_padded(spark, tmp_path):
    assert rows(read_csv(spark, write(tmp_path / "s.csv", "a,b,c\n1,2\n3,4,5\n"))) == [(1, 2, None), (3, 4, 5.0)]


def test_load_errors(spark, tmp_path):
    for name, text in (("long.csv", "a,b\n1,2,3\n"), ("empty.csv", ""), ("data.json", "{}")):
        with pytest.raises(LoadError):
            read_csv(spark, write(tmp_path / name, text))
    with pytest.raises(LoadError):
        read_csv(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValidationError):
        read_csv(spark, write(tmp_path / "header.csv", "a,b\n"))


def test_single_column_warns(spark, tmp_path, caplog):
    read_csv(spark, write(tmp_path / "one.csv", "a;b\n1;2\n"))
    assert "delimiter" in caplog.text


def test_csv_round_trip_of_awkward_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, "two\nlines"), (3, " padded "), (4, None), (5, "back\\slash")], "i long, s string")
    write_table(df, str(tmp_path / "out.csv"))
    assert rows(read_csv(spark, str(tmp_path / "out.csv")).selectExpr("i", "s"))[:1] == [(1, 'say "hi", ok')]
    assert {r["i"]: r["s"] for r in read_csv(spark, str(tmp_path / "out.csv")).collect()} == {
        1: 'say "hi", ok', 2: "two\nlines", 3: " padded ", 4: None, 5: "back\\slash"}


def test_saved_run(spark, shop, tmp_path):
    run = clean(shop)
    paths = save_run(run, str(tmp_path / "run"), "shop", form="parquet")
    assert rows(spark.read.parquet(paths["data"])) == rows(run.cleaned)
    assert spark.read.json(paths["operations"]).count() == run.operations_table().count()
    assert spark.read.json(paths["findings"]).count() == run.profile.findings().count()
    assert read_plan(spark, paths["plan"]) == run.plan
    summary = json.loads(spark.read.text(paths["summary"]).first()[0])
    assert summary["summary"]["has_critical_issues"] and summary["dataset"]["rows_removed"] == 1
    assert len(summary["analysis"]) == 7 and len(summary["cleaning"]) == 6 and summary["output_files"] == paths
    assert "details" not in summary["analysis"][0]


def test_csv_of_the_cleaned_table_and_dry_run(spark, shop, tmp_path):
    write_cleaned(clean(shop, Options()), str(tmp_path / "cleaned.csv"))
    assert read_csv(spark, str(tmp_path / "cleaned.csv")).count() == 10
    with pytest.raises(PlanError):
        write_cleaned(clean(shop, dry_run=True), str(tmp_path / "never.csv"))


def test_analysis_document(spark, shop, tmp_path):
    write_analysis(profile(shop), str(tmp_path / "analysis"), "shop")
    document = json.loads(spark.read.text(str(tmp_path / "analysis")).first()[0])
    assert document["dataset"] == {"rows": 11, "columns": 9} and len(document["results"]) == 7
    assert document["results"][0]["details"]["total_missing_cells"] == 16


def random_csv(draw, lines, crlf):
    """A text with quoted fields over several lines, doubled quotes, quotes within plain fields, empty fields and lines."""
    def field():
        kind = draw.random()
        if kind < 0.35:
            inner = "".join(draw.choice(['x', 'é', ',', '\n', '""', ' ', '\n\n', '1']) for _ in range(draw.randint(0, 12)))
            return f'"{inner}"'
        return "".join(draw.choice("ab 7é") for _ in range(draw.randint(0, 6))) + ('5" pipe' if kind > 0.9 else "")

    text = "a,b,c\n" + "".join(",".join(field() for _ in range(3)) + "\n" + "\n" * (draw.random() < 0.05) for _ in range(lines))
    return text.replace("\n", "\r\n") if crlf else text


@pytest.mark.parametrize("crlf", [False, True])
def test_records_over_blocks_equal_those_of_the_whole_file(spark, tmp_path, crlf):
    draw = random.Random(7)
    folder = tmp_path / "t.csv"
    folder.mkdir()
    for i, lines in enumerate((300, 200, 40, 3)):
        (folder / f"{i}.csv").write_bytes(random_csv(draw, lines, crlf).encode())
    (folder / "4.csv").write_bytes(("a,b,c\n1,\"" + "long, \n" * 900 + "\",z\n2,x,y").replace("\n", "\r\n" if crlf else "\n").encode())
    schema = "a string, b string, c string, d string"
    whole = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", True).schema(schema).csv(str(folder))
    form = {"sep": ",", "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    expected = rows(whole)
    for size in ("128m", "700", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            made = records(spark, str(folder))
            found = made.select(F.from_csv("value", schema, form).alias("r")).select("r.*")
            assert rows(found) == expected, size
            if size == "700":
                assert made.rdd.getNumPartitions() > 20
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_whether_a_line_ends_within_a_field():
    for line, outside, inside in ((b"a,b", False, True), (b'a,"b', True, False), (b'a,"b"', False, False), (b'"', True, False), (b'""', False, True), (b'"""', True, False),
                                  (b'a"b', False, False), (b'","', False, True), (b'x"",""y', False, True), (b'","x', False, True), (b'"a""b', True, False), (b'x","', True, True)):
        assert ends_inside(line, False, b",") == outside, line
    assert ends_inside(b'x', True, b",") and not ends_inside(b'x"', True, b",") and ends_inside(b'x""', True, b",") and ends_inside(b'x","y', True, b",")


def test_embedded_line_ends_in_many_tasks(spark, tmp_path):
    text = "n,s\n" + "".join(f'{i},"line {i}\nand, more"\n' for i in range(3000))
    path = write(tmp_path / "many.csv", text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = read_csv(spark, path)
        assert df.rdd.getNumPartitions() >= len(text) // 8192
        assert df.count() == 3000 and df.dtypes == [("n", "bigint"), ("s", "string")]
        assert df.where("s = concat('line ', n, '\n', 'and, more')").count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_analysis_with_every_finding(spark, shop, tmp_path):
    found = profile(shop, row_id="id")
    write_analysis(found, str(tmp_path / "analysis"), "shop", findings=str(tmp_path / "findings"))
    document = json.loads(spark.read.text(str(tmp_path / "analysis")).first()[0])
    saved = spark.read.json(document["findings"])
    assert saved.count() == found.findings().count()
    spellings = {r["value"] for r in saved.where("check = 'category_consistency' AND column = 'city'").collect()}
    assert {"Oslo", "oslo ", "Bergen", "BERGEN"} <= spellings
    outlier = saved.where("check = 'outliers' AND column = 'price'").selectExpr("from_json(details.outlier_examples, 'array<double>') AS examples", "sample_ids").first()
    assert outlier.examples == [-999.0, 60000.0] and outlier.sample_ids == ["6", "10"]
    duplicate = saved.where("check = 'duplicates'").first()
    assert duplicate.sample_ids == ["7"] and duplicate.n == 1


def test_options_on_the_cluster_s_file_system(spark, tmp_path):
    options = Options.from_dict({"outliers": {"action": "cap"}, "suspicious_values": {"sentinel_values": [-7, 7]}})
    write_options(options, spark, str(tmp_path / "options"))
    assert read_options(spark, str(tmp_path / "options")) == options
    (tmp_path / "lines.json").write_text('{\n  "outliers":\n  {"action": "drop"}\n}\n')
    found = read_options(spark, str(tmp_path / "lines.json"), {"outliers": {"method": "zscore"}})
    assert found.outliers.action == "drop" and found.outliers.method == "zscore"
    (tmp_path / "bad.json").write_text("{")
    for path in ("bad.json", "none.json"):
        with pytest.raises(OptionsError):
            read_options(spark, str(tmp_path / path))
