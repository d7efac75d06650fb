"""Features, files and whole pipelines."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascale.operators import qc
from mutascale.operators.collinearity import correlation_matrix
from mutascale.operators.intervals import panel_length
from mutascale.operators.qc import QcRules
from mutascale.plans import cleanse, features, importance, restrict, sweep
from mutascale.sources import readers, schemas, writers


def sheet(spark, rows, extra=""):
    return spark.createDataFrame(rows, "`panel ID` string, recall double, precision double, RMSLE double" + extra)


def test_feature_steps_only_where_columns_exist(spark):
    ready = features.prepare_features(sheet(spark, [("p12a", 1.0, 0.5, 0.1)]), remove_prefix=True)
    assert ready.columns == ["panel ID", "recall", "precision", "RMSLE", "Method", "rgbrp"]
    assert (ready.first().Method, ready.first().rgbrp) == (12, 1.0)
    kept = features.prepare_features(sheet(spark, [("p12a", 1.0, 0.5, 0.1)]), remove_prefix=False)
    assert kept.first().Method == "p12"


def test_whole_sheet(spark):
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.PARAMETER_SHEET.fields)
    rows = [
        ("p1a", 2.0, 30, "ultrasonic", "No", 150, 1000, "X", "hg19", "VarDict, GATK Mutect2", 0.02, 0.05, "Missense, Indel", "SNP", "tumor-only"),
        ("p2", 4.0, 20, "enzyme", None, 100, 500, "X", "hg38", "other", 0.07, 0.1, "Other", "Known, Hotspot", "tumor-normal"),
        ("p3", 4.0, 20, "enzyme", "Yes", 100, 500, "Y", "hs37d5", "Other", 0.03, None, "nonsense", "", None),
    ]
    parameters = spark.createDataFrame(rows, columns)
    accuracy = sheet(spark, [("p1a", 1.0, 0.5, 0.1), ("p2", 0.5, 0.5, 0.2), ("p3", 0.8, 1.0, 0.3)])
    joined = accuracy.join(parameters, "panel ID")
    ready = {r["panel ID"]: r for r in features.prepare_features(joined, False).collect()}
    first, second, third = ready["p1a"], ready["p2"], ready["p3"]
    assert first["Gene Count per Mb"] == 15.0 and "Gene Count" not in first.asDict() and "Callers" not in first.asDict()
    assert (first["DNA shearing"], second["DNA shearing"]) == (1, 2)
    assert (first.UMI, second.UMI, third.UMI) == (False, True, True)
    assert first["Reads Length / 50"] == 3.0 and first["Sequencing Depth / 100"] == 10.0
    assert first["Sequencing Platform"] == 0.5 and third["Sequencing Platform"] == pytest.approx(0.25)
    assert (first["Reference Genome"], second["Reference Genome"], third["Reference Genome"]) == (0, None, 2)
    assert first["Caller: VarDict"] and first["Caller: Mutect2"] and not first["Caller: Delly"]
    assert second["Caller: other"] and not third["Caller: other"]
    assert (first["somatic VAF cut-off"], second["somatic VAF cut-off"], third["TMB VAF cut-off"]) == (1.0, None, None)
    assert first["Involved: Indel"] and not third["Involved: Nonsense"] and second["Filter: Hotspot"]
    assert (first["Germline Strategy"], second["Germline Strategy"], third["Germline Strategy"]) == (False, True, None)


def test_platform_without_target(spark):
    df = spark.createDataFrame([("p1", "X")], "`panel ID` string, `Sequencing Platform` string")
    with pytest.raises(ValueError, match="target"):
        features.prepare_features(df, True)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_panel_files(spark, tmp_path):
    write(tmp_path / "beds" / "panel01_x.bed", "chr1\t0\t500000\nchr1\t250000\t750000\n")
    write(tmp_path / "beds" / "panel02_x.bed", "chr2\t0\t1000\n")
    write(tmp_path / "beds" / "note.bed", "chr9\t0\t1\n")
    folder = str(tmp_path / "beds")
    rows = readers.read_panels(spark, folder, ["panel01"]).collect()
    assert {tuple(r) for r in rows} == {("panel01", "chr1", 0, 500000), ("panel01", "chr1", 250000, 750000)}
    assert readers.read_panels(spark, folder).select("panel").distinct().count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_panels(spark, folder, ["panel77"])
    with pytest.raises(FileNotFoundError):
        readers.read_panels(spark, str(tmp_path / "nowhere"))
    with pytest.raises(FileNotFoundError):
        readers.read_parquet(spark, str(tmp_path / "nowhere"))


def test_sheets_and_tables(spark, tmp_path):
    path = write(tmp_path / "sheet.csv", "title\nhead,er\np1,0.9,x,0.8,y,z\np2,0.7,x,0.6,y,z\n")
    columns = schemas.ACCURACY_SHEET.fields[:3]
    rows = readers.read_sheet(spark, path, T.StructType(columns), [0, 1, 3], skip_rows=2).collect()
    assert [tuple(r) for r in rows] == [("p1", 0.9, 0.8), ("p2", 0.7, 0.6)]
    ids = write(tmp_path / "ids.csv", "other,panel,newID\n1,panel01,p1a\n2,panel02,p1b\n3,panel03,p2\n")
    assert [r.newID for r in readers.read_unique_panels(spark, ids).collect()] == ["p1a", "p2"]
    lab = write(tmp_path / "lab.tsv", "product\tsample\tpanel_id\tgroup\twesTMB\textra\nx\tA1\tl\tother\t3.5\t1\n")
    assert tuple(readers.read_typed_table(spark, lab, schemas.OBSERVATIONS).first()) == ("A1", "l", "x", "other", 3.5)
    out = str(tmp_path / "out")
    writers.write_text_table(spark.createDataFrame([("a", 1)], "x string, y int"), out)
    assert tuple(readers.read_text_table(spark, out, ["y", "x"]).first()) == ("1", "a")


RAW = sorted({
    *schemas.COMPLETE_COLUMNS} - {"Study_Abbreviation", "VAF", "purity", "wesTMB", "rate", "hash", "cosmic96_coding"}
    - set(schemas.ANNOTATION_RENAMES.values()) - set(schemas.ANNOTATION_FREQUENCIES))


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    """The cleansing pipeline from text files to the published tables."""
    folder = tmp_path_factory.mktemp("cleanse")

    def row(sample, start, kind="Missense_Mutation", alt=20, label="PASS", consequence="x"):
        values = dict.fromkeys(RAW, "same")
        values.update(
            Tumor_Sample_Barcode=sample, Chromosome="1", Start_Position=start, End_Position=start, Reference_Allele="A",
            Tumor_Seq_Allele2="T", t_depth=100, t_ref_count=50, t_alt_count=alt, n_depth=9, n_ref_count=9, n_alt_count=0,
            FILTER=label, Variant_Classification=kind, Consequence=consequence, odd="constant",
        )
        return values

    names = [*RAW, "FILTER", "odd"]
    rows = (
        [row("SAMPLE-00000-01A", i) for i in range(400)] + [row("SAMPLE-00000-02A", i, "Silent") for i in range(3)]
        + [row("SAMPLE-00000-03A", i, label="wga") for i in range(3)] + [row("SAMPLE-00000-04A", i, alt=2) for i in range(3)]
        + [row("SAMPLE-00000-05A", 1, consequence="synonymous_variant")]
    )
    text = "\n".join(["\t".join(names), *["\t".join(str(r[c]) for c in names) for r in rows]])
    variants = readers.read_text_table(spark, write(folder / "v.tsv", text + "\n"))
    studies = "".join(f"SAMPLE-00000-0{i}A\tCOAD\n" for i in (1, 2, 3, 4, 5))
    clinical = readers.read_text_table(spark, write(folder / "c.tsv", "Tumor_Sample_Barcode\tStudy_Abbreviation\n" + studies))
    purity = readers.read_typed_table(spark, write(folder / "p.tsv", "array\tpurity\nSAMPLE-00000-01\t0.7\n"), schemas.PURITY)
    cleaned = cleanse.clean(variants, clinical, purity)
    assert "odd" not in cleaned.columns and cleanse.hash_collisions(cleaned, schemas.KEY_COLUMNS).count() == 0
    ordered = cleanse.ordered(cleaned)
    writers.write_annotator_input(ordered, str(folder / "avinput"))
    head = ["hash", *schemas.ANNOTATION_FREQUENCIES, "cosmic96_coding"]
    lines = ["\t".join(head)]
    for r in spark.read.option("sep", "\t").csv(str(folder / "avinput")).where("_c1 < 5").collect():
        lines.append("\t".join([r[5], *["0.25" if i == 0 else "." for i in range(len(schemas.ANNOTATION_FREQUENCIES))], "7"]))
    annotation = readers.read_annotation(spark, write(folder / "anno.txt", "\n".join(lines) + "\n"))
    table = cleanse.published(cleanse.annotate(ordered, annotation))
    paths = writers.write_publications(table, str(folder / "out"))
    return {name: spark.read.parquet(path) for name, path in paths.items()}


def test_published_tables(published):
    complete, minimal = published["complete"], published["minimal"]
    assert [len(published[n].columns) for n in ("complete", "concise", "minimal")] == [105, 76, 11]
    assert complete.columns == schemas.COMPLETE_COLUMNS
    rows = {r.Tumor_Sample_Barcode: r for r in minimal.groupBy("Tumor_Sample_Barcode").agg(
        F.count("*").alias("n"), F.first("wesTMB").alias("tmb"), F.first("rate").alias("rate"),
        F.first("purity").alias("purity"), F.first("Variant_Classification").alias("kind"),
    ).collect()}
    assert set(rows) == {"SAMPLE-00000-01A", "SAMPLE-00000-02A", "SAMPLE-00000-05A"}
    first, silent, single = (rows[f"SAMPLE-00000-0{i}A"] for i in (1, 2, 5))
    assert (first.n, first.tmb, first.rate, first.purity) == (400, 400 / 34, True, 0.7)
    assert (silent.n, silent.tmb, silent.rate, silent.purity) == (3, None, True, None)
    assert (single.tmb, single.rate, single.kind) == (1 / 34, False, "Synonymous_Mutation")
    annotated = complete.where(F.col("GMAF") == 0.25)
    assert annotated.count() == 9 and annotated.where("cosmic96_coding = '7'").count() == 9


def test_sweep_round_trip(spark, tmp_path):
    rng = range(600)
    rows = [
        ("c1", i, i, sweep.BASE_CLASSES[i % 5], f"s{i * 7 % 40}", ".", 0.05 * (i % 7), 3.0 * (i * 7 % 40) % 31, (3 * (i * 7 % 40) % 31) >= 10,
         "0.01" if i % 2 else ".", str(i % 30) if i % 3 else ".", i % 11 == 0, False, "G") for i in rng
    ]
    names = [f.name for f in schemas.SWEEP_VARIANTS.fields]
    types = ["string", "int", "int", "string", "string", "string", "double", "double", "boolean", "string", "string", "boolean", "boolean", "string"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
    mark = F.substring("Tumor_Sample_Barcode", 2, 3).cast("int") % 4 == 0
    panels = spark.createDataFrame([("p1a", "c1", 0, 300), ("p2", "c1", 100, 700)], "panel string, chr string, istart int, iend int")
    placed = restrict.sweep_input(df.where(~mark), df.where(mark), panels)
    results = sweep.sweep(placed, panel_length(panels), sweep.Grid(gene_content=False), expand=False)
    path = str(tmp_path / "results")
    writers.write_by_panel(results, path)
    genes = spark.createDataFrame([("p1a", 10), ("p2", 30)], "`panel ID` string, `Gene Count` int")
    labelled = features.label_results(readers.read_results(spark, path), genes)
    ready = features.prepare_features(labelled, remove_prefix=True)
    assert ready.count() == 2 * 30 * 2 * 5
    assert {*features.MODEL_FEATURES, *features.MODEL_TARGETS} <= set(ready.columns)
    correlations, inflation = importance.collinearity(ready)
    assert correlations.count() == 55 and inflation.count() == 11
    sizes = correlation_matrix(ready, ["Exonic Size", "Gene Count per Mb"]).first()
    assert abs(sizes.r) == pytest.approx(1.0)


def test_old_label_spelling(spark):
    df = spark.createDataFrame([("p1", True)], "panel_id string, `Involved: Slient` boolean")
    assert "Involved: Silent" in features.label_results(df).columns


def test_scan_is_pruned(spark, plan):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = QcRules(sample="l_orderkey", depth="l_quantity", alt_count="l_tax", variant_class="l_returnflag", vaf="v")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    try:
        text = plan(qc.site_filter(lines, rules).select("array"))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(l_quantity,25.0)" in text and "l_extendedprice" not in text


def test_published_set_is_seen_as_a_whole(spark, tmp_path):
    folder = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        readers.read_publication(spark, folder, "minimal")

    def rows(n):
        return spark.range(n).select(*[F.col("id").cast("string").alias(c) for c in schemas.COMPLETE_COLUMNS])

    writers.publish_set(rows(3), folder)
    later = writers.publish_set(rows(5), folder)
    for name, width in (("complete", 105), ("concise", 76), ("minimal", 11)):
        stored = readers.read_publication(spark, folder, name)
        assert stored.count() == 5 and len(stored.columns) == width
    broken = tmp_path / "set" / "set-99999999999999999999-x"  # tables without the marker: a run that failed
    writers.write_publications(rows(7), str(broken))
    assert readers.read_publication(spark, folder, "complete").count() == 5
    assert (tmp_path / "set" / later.rsplit("/", 1)[1] / writers.COMMITTED).exists()


def test_panel_files_round_trip(spark, tmp_path):
    panels = spark.range(300).select(
        F.concat(F.lit("panel"), F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 9)).alias("panel"),
        F.concat(F.lit("chr"), F.col("id") % 5).alias("chr"), F.col("id").cast("int").alias("istart"), (F.col("id") + 9).cast("int").alias("iend"),
    )
    writers.write_panels(panels, str(tmp_path / "beds"))
    back = readers.read_panels(spark, str(tmp_path / "beds"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, panels.collect()))
    assert not [p.name for p in (tmp_path / "beds").iterdir() if p.name.startswith("_")]


def test_sheets_skip_the_head_of_every_file(spark, tmp_path):
    for i in range(4):
        write(tmp_path / "sheets" / f"s{i}.csv", "title\n\"head\ner\",x\n" + "".join(f"p{i}{k},0.9,x,0.8\n" for k in range(3)))
    columns = T.StructType(schemas.ACCURACY_SHEET.fields[:3])
    rows = readers.read_sheet(spark, str(tmp_path / "sheets"), columns, [0, 1, 3], skip_rows=2).collect()
    assert sorted(r[0] for r in rows) == [f"p{i}{k}" for i in range(4) for k in range(3)]
