import json

import pytest
from pyspark.sql import functions as F

from askframe.engine import Engine
from askframe.functions.vectors import cosine, embed, embed_texts, similarity
from askframe.operators import compare, evaluation, graph, journal, profile, workload
from askframe.operators.joinpath import find_path, paths_between
from askframe.plans.guard import timed, unsafe_sql
from askframe.plans.model import Plan, PlanError
from askframe.retrieval import lexical
from askframe.retrieval.documents import Document, HybridRetriever, VectorStore, document_frame, documents_of
from askframe.sources.catalog import Catalog
from askframe.sources.csv_ingest import read_csv, snake_case
from askframe.sources.examples import BUSINESS, demo_catalogs
from askframe.sources.tables import star_catalog
from askframe.streaming.telemetry import windowed_hits
from askframe.surfaces import cli
from askframe.surfaces.facade import Tools
from askframe.surfaces.http import handle


def test_csv_ingest(spark, tmp_path):
    path = tmp_path / "sales.csv"
    path.write_text('﻿UniqueID, SalePrice ,SaleDate,PropertyAddress,Acreage,LandUse\n1,"$1,200,000","April 9, 2013","320  11TH AVE S, NASHVILLE",0.5,DUPLEX\n2,,,,abc,\n', "utf-8")
    df = read_csv(spark, str(path))
    assert df.columns == ["unique_id", "sale_price", "sale_date", "property_address", "acreage", "land_use"]
    one, two = df.orderBy("unique_id").collect()
    assert (one.sale_price, str(one.sale_date), one.acreage) == (1200000, "2013-04-09", 0.5)
    assert list(two[1:]) == [None] * 5
    assert [snake_case(x) for x in ("SoldAsVacant", " Full Bath ", "ID")] == ["sold_as_vacant", "full_bath", "id"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "b")], "n int, s string")
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert (got["n"].row_count, got["n"].non_null_count, got["n"].distinct_count, got["n"].minimum, got["n"].null_ratio) == (4, 3, 2, "1", 0.25)
    assert [r.value for r in profile.samples(df, "s").collect()] == ["a", "b"]
    assert profile.profile(df.limit(0)).first().null_ratio == 0.0


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0, 2.0], [5.0, 5.0, 1.0, 9.0], list(map(float, range(100)))])
def test_nearest_rank(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = profile.nearest_rank(df, "v", [0.5, 0.95], ["p50", "p95"]).first()
    assert (got.p50, got.p95) == (workload.nearest_rank(values, 0.5), workload.nearest_rank(values, 0.95))


def test_compare(spark):
    a = spark.createDataFrame([(1, 0.1 + 0.2), (1, 0.3)], "k int, v double")
    b = spark.createDataFrame([(1, 0.3), (1, 0.3)], "k int, v double")
    assert compare.same_rows(a, b) and not compare.same_rows(a, b.limit(1)) and not compare.same_rows(a, b.drop("v"))


def test_vectors(spark):
    df = spark.createDataFrame([(1, "Total sales by region"), (2, ""), (3, None)], "k int, t string")
    got = {r.k: r.vector for r in embed_texts(df, "k", "t").collect()}
    assert got[1] == pytest.approx(embed("Total sales by region")) and got[2] == [0.0] * 128 and got[3] == [0.0] * 128
    pair = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r.c for r in pair.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()] == pytest.approx([similarity([1, 2], [2, 1]), 0.0, 0.0])


def test_join_paths(spark, folder):
    catalog = star_catalog(spark, folder)
    path = find_path(catalog, "lineitem", "region")
    assert path.hops in (3, 4) and path.joins[-1].table == "region"
    assert find_path(catalog, "orders", "events") is None and find_path(catalog, "orders", "orders").hops == 0
    assert {(p.source, p.target) for p in paths_between(catalog, ["orders", "customer", "events"])} == {("orders", "customer")}


def test_graph(spark):
    made = graph.SchemaGraph.of(demo_catalogs(spark))
    reached = made.expand(["concept:near docks"], 1)
    assert reached["rides.bike_trips.near_dock_id"] == 1
    assert all(e.source < e.target for e in made.undirected())
    nodes, edges = made.frames(spark)
    seeds = spark.createDataFrame([("concept:near docks",)], "node string")
    assert {r.node: r.depth for r in graph.reach(edges, seeds, 2).collect()} == made.expand(["concept:near docks"], 2)
    assert any(e.kind == "SIMILAR_TO" for e in made.edges) and nodes.count() == len(made.nodes)


def test_journal(spark, tmp_path):
    book = journal.FeedbackJournal(spark, str(tmp_path / "feedback"))
    signature = journal.plan_signature(Plan("orders"))
    assert book.prior("q", signature) == 0.0
    for ok, score in ((True, 1.0), (True, 5.0), (False, 0.5)):
        book.record("q", signature, ok, score)
    assert book.prior("q", signature) == pytest.approx(0.5) and book.recent(2).count() == 2
    said = journal.Conversation.of([{"role": "user", "content": f"m{i}"} for i in range(20)] + [{"role": "tool", "content": "x"}, {"role": "user", "content": " "}])
    assert len(said.messages) == 10


def test_retrieval(spark, tmp_path):
    documents = documents_of(Catalog.from_dict(BUSINESS))
    found = HybridRetriever(documents).search("total amount of orders", 3)
    assert found and found[0]["table"] == "orders" and len(found) <= 3
    with pytest.raises(ValueError):
        HybridRetriever(documents).search("x", 0)
    frame = document_frame(spark, documents)
    best = lexical.search(frame, "key", "text", "order amount", 5, "aliases").collect()
    scores = {d.key: lexical.score("order amount", d.text, d.aliases) for d in documents}
    assert all(r.score == pytest.approx(scores[r.key]) for r in best)
    store = VectorStore(spark, str(tmp_path / "vectors"))
    assert store.get_or_embed(frame).count() == len(documents)
    changed = document_frame(spark, [Document("main", "table", "orders", description="changed"), *[d for d in documents if d.key != "main.orders"]])
    assert store.get_or_embed(changed).count() == len(documents)


def test_guard(spark):
    slow = spark.range(4).mapInPandas(lambda it: (__import__("time").sleep(30) or p for p in it), "id long")
    with pytest.raises(PlanError) as wrong:
        timed(slow, lambda d: d.collect(), 1.0)
    assert wrong.value.code == "QUERY_TIMEOUT"
    assert unsafe_sql("select 1; drop table x").code == "UNSAFE_SQL" and unsafe_sql("select 1") is None


def test_evaluation_and_workload(tmp_path):
    engine = Engine(Catalog.from_dict(BUSINESS))
    wanted = engine.parse("show all orders").plan
    cases = [evaluation.Case("1", "show all orders", plans=(wanted,), labels=("scan",)), evaluation.Case("2", "drop orders", labels=("unsafe",))]
    report = evaluation.report(evaluation.evaluate(cases, engine.parse))
    assert report["success"] == 1 and report["labels"]["scan"] == {"total": 1, "success": 1} and report["failures"] == {"planning": 1}
    assert evaluation.same_results([{"a": 1.0}, {"a": 2.0}], [{"a": 2.0000000001}, {"a": 1.0}])
    assert not evaluation.same_results([{"a": 1.0}, {"a": 2.0}], [{"a": 2.0}, {"a": 1.0}], ordered=True)
    assert evaluation.set_scores([], []).f1 == 1.0
    made = workload.Workload()
    assert [q.topic for q in made.sudden_shift(4)] == ["housing", "housing", "traffic", "traffic"]
    assert workload.Workload().uniform(9) == workload.Workload().uniform(9)
    as_json, as_text = workload.write_reports(workload.ablation(made.skewed(5), {"rules": engine.parse}), str(tmp_path))
    assert json.loads(as_json.read_text())[0]["questions"] == 5 and as_text.read_text().startswith("| name")


def test_surfaces(tmp_path, capsys):
    engine = Engine(Catalog.from_dict(BUSINESS))
    assert handle(engine, "/parse", b'{"query": "show all orders"}')[0] == 200
    assert handle(engine, "/parse", b"{")[1]["error"]["code"] == "INVALID_JSON"
    assert handle(engine, "/parse", b'{"query": ""}')[1]["error"]["code"] == "INVALID_REQUEST"
    assert handle(engine, "/other", b"{}") [0] == 404
    tools = Tools(engine)
    assert tools.validate_plan({"source": "orders"})["valid"] and not tools.validate_plan({"source": "no"})["valid"]
    assert set(tools.tools()) >= {"parse_query", "execute_query", "search_schema", "inspect_schema"}
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps({"tickets": {"columns": {"id": {"type": "integer"}, "priority": {"type": "string"}}}}))
    assert cli.main(["parse", "show all tickets", "--schema", str(schema)]) == 0
    assert json.loads(capsys.readouterr().out)["sql"] == "SELECT * FROM tickets"
    assert cli.main(["parse", "drop tickets", "--schema", str(schema)]) == 1
    assert cli.main(["nonsense"]) == 2 and cli.main(["parse", "x", "--schema", str(tmp_path / "none.json")]) == 2


def test_stream(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windowed_hits(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("hits").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("hits").agg(F.sum("hits")).first()[0] == events.count()
