"""Functions, sources, sinks, extraction, hypotheses, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from tessergraph.functions import cypher, ids, records, text, vectors
from tessergraph.operators import extraction, hypothesis, similarity
from tessergraph.operators.graph import Graph
from tessergraph.operators.triplets import Triplets
from tessergraph.sources import readers, writers
from tessergraph.sources.store import Registry, Store, subgraph_file, subgraph_name
from tessergraph.streaming import incremental


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    a, b = arr(0.1, 0.2, 0.3), arr(0.2, 0.3, 0.4)
    r = one(spark, vectors.dot(a, b), vectors.l2(a, b), vectors.cosine(a, b), vectors.cosine(a, arr(0, 0, 0)), vectors.similarity(a, b, "euclidean"), vectors.distance(a, b, "dot_product"))
    assert r[0] == pytest.approx(0.2) and r[1] == pytest.approx(0.03**0.5) and r[2] == pytest.approx(0.9925833)
    assert r[3] is None and r[4] == pytest.approx(1 / (1 + 0.03**0.5)) and r[5] == pytest.approx(-0.2)
    with pytest.raises(ValueError):
        vectors.similarity(a, b, "nope")


def test_pairs_and_nearest_do_not_depend_on_blocks(spark):
    rows = spark.createDataFrame([(i, [float((i * 7) % 11), float((i * 5) % 13), 1.0]) for i in range(40)], "id long, vec array<double>")
    one_block = {(r.a, r.b, round(r.sim, 9)) for r in similarity.similar_pairs(rows, 0.9).collect()}
    many = {(r.a, r.b, round(r.sim, 9)) for r in similarity.similar_pairs(rows, 0.9, block=7).collect()}
    assert one_block == many and one_block and all(a < b for a, b, _ in many)
    assert sorted(map(tuple, similarity.nearest(rows, 3).collect())) == sorted(map(tuple, similarity.nearest(rows, 3, block=7).collect()))


def test_embedding_cache_through(spark):
    cache = spark.createDataFrame([("a", [1.0])], "text string, vec array<double>")
    texts = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    got = {r.text: r.vec for r in similarity.cached(texts, cache, lambda ts: [[float(len(t))] for t in ts]).collect()}
    assert got == {"a": [1.0], "b": [1.0]}
    assert similarity.cached(texts, cache).where("text = 'b'").first().vec is not None
    rows = cache.withColumnRenamed("text", "id")
    assert similarity.top_matches(rows, [1.0], 1).first().id == "a"


def test_ids(spark):
    r = one(spark, ids.item_id(doi=F.lit("10.1/x"), pm_id=F.lit(5)), ids.item_id(doi=F.lit("10.1/x"), pm_id=F.lit(None)), ids.item_id(doi=F.lit("")))
    import hashlib

    assert r[0] == hashlib.sha256(b"doi:10.1/x|pm_id:5").hexdigest() and r[1] == hashlib.sha256(b"doi:10.1/x").hexdigest() and r[2] is None
    assert ids.subgraph_digest("a", "b", ["b", "a"], []) == ids.subgraph_digest("a", "b", ["a", "b"], [])
    assert ids.kg_version("refine", {"b": 1, "a": 2}) == ids.kg_version("refine", {"a": 2, "b": 1})


def test_cypher(spark):
    r = one(spark, cypher.edge_text(F.lit("a b"), F.lit("r"), F.lit("c-d")), cypher.path_text(F.array(F.lit("A"), F.lit("E"))))
    assert r[0] == "(`a b`)-[:r]->(`c-d`)" and r[1] == "A -> E"


def test_records(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "y")], "PMID long, gsmeta string, gs_metadata string")
    got = records.canonical_names(df)
    assert got.columns == ["pm_id", "gs_meta"] and sorted(r.gs_meta for r in got.collect()) == ["x", "y"]
    assert records.metadata_of("{'a': 1, 'b': None}") == {"a": "1"} and records.metadata_of('{"a": [1]}') == {"a": "[1]"} and records.metadata_of("junk") == {} and records.metadata_of(None) == {}
    with pytest.raises(Exception, match="identifier"):
        records.with_id(spark.createDataFrame([(None,)], "doi string")).collect()
    a = spark.createDataFrame([(1, "d1", "p1"), (2, None, "p2")], "rec int, doi string, pm_id string")
    b = spark.createDataFrame([(9, "d1", "p9"), (8, None, "p2"), (7, None, None)], "rec int, doi string, pm_id string")
    assert sorted(map(tuple, records.linked(a, b).collect())) == [(1, 9, 1, 1), (2, 8, 1, 0)]
    c = spark.createDataFrame([("x", [("y",)])], "id string, citations array<struct<id:string>>")
    assert tuple(records.citations(c).first()) == ("x", "y", "citations")


def test_chunking(spark):
    t = "One two three. Four five six? Seven eight nine! Ten eleven twelve."
    chunks = text.fixed_chunks(t, 4, 0)
    assert all(text.word_count(c) <= 4 for c in chunks) and " ".join(chunks).split() == t.split()
    assert chunks[0].endswith(".") and not any(c[:1] in ".?!" for c in chunks)
    assert text.fixed_chunks("", 4, 0) == [] and text.fixed_chunks("a b", 4, 0) == ["a b"] and text.fixed_chunks(None) == []
    overlapping = text.fixed_chunks("a b c d e f g h", 4, 2)
    assert overlapping[1].split()[:2] == overlapping[0].split()[-2:]
    r = one(spark, text.repair(F.array(F.lit("a"), F.lit("? b"), F.lit(".c"))))
    assert r[0] == text.repaired(["a", "? b", ".c"]) == ["a?", "b.", "c"]
    assert one(spark, text.sections(F.lit("0 a\n\n1 b\n \n2 c\n\n")))[0] == ["0 a", "1 b", "2 c"]
    df = text.chunk_fixed(spark.createDataFrame([("i", t)], "id string, text string"), "id", "text", 4, 0)
    assert [x.chunk_id for x in df.orderBy("pos").collect()][:2] == ["i_0", "i_1"]


def test_reply_parsers(spark):
    reply = F.lit("Title: My idea\nHypothesis Statement: it works\nReferences:\n1. one\n- two\nother ACCEPT")
    score, why = text.rating(F.lit("good rating=4 ok"))
    r = one(spark, score, why, text.rating(F.lit("none"))[0], text.unit_score(F.lit("I say 0.75 of 1")), text.unit_score(F.lit("7")), text.unit_score(F.lit("x")), text.title(reply, F.lit("d")), text.references(reply), text.decision(reply), text.title(F.lit("x"), F.lit("d")))
    assert r[0] == 4 and r[1] == "good  ok" and r[2] is None and r[3] == 0.75 and r[4] == 1.0 and r[5] == 0.0
    assert r[6] == "My idea" and r[7] == ["1. one", "- two"] and r[8] == "ACCEPT" and r[9] == "d"


def test_extraction(spark):
    chunks = spark.createDataFrame([("i", "i_0", "Alpha binds Beta. x"), ("i", "i_1", "boom"), ("j", "j_0", None)], "item_id string, chunk_id string, text string")

    def extractor(t):
        if t == "boom":
            raise RuntimeError("no")
        return [{"node1": "Alpha", "edge": "binds", "node2": "Beta"}] if t else []

    found = extraction.extract(chunks, extractor)
    rows = {r.chunk_id: r for r in found.collect()}
    assert rows["i_0"].snippet == "Alpha binds Beta." and "RuntimeError" in rows["i_1"].error and "j_0" not in rows
    assert extraction.triplets_of(found).df.first().metadata == {"chunk_id": "i_0", "snippet": "Alpha binds Beta."}
    same = extraction.harmonise(found, lambda ts: [*ts, ("a", "b", "c")]).collect()
    assert {(r.node_1, r.snippet is not None) for r in same} == {("Alpha", True), ("a", False)}
    t = spark.createDataFrame([("i_0", "Alpha", "binds", "Beta", None), ("gone", "a", "b", "c", None)], "chunk_id string, node_1 string, edge string, node_2 string, snippet string")
    assert [r.snippet for r in extraction.ground(t, chunks).collect()] == ["Alpha binds Beta."]
    assert extraction.distil(chunks.where("chunk_id = 'i_1'"), lambda s: "sum", lambda s: "- " + s).first().text == "sum\n\n- sum"


def test_extractor_loops():
    base = lambda t: [("a", "r", "b")]
    assert extraction.refine(lambda t, now: '[{"node_1": "x", "edge": "r", "node_2": "y"}]', 1)(base)("t") == [("x", "r", "y")]
    assert extraction.refine(lambda t, now: "junk", 2)(base)("t") == [("a", "r", "b")]
    calls = []
    assert extraction.review(lambda t, now, told: calls.append(told) or [("a", "r", "b")], lambda t, now: "fine ACCEPT" if len(calls) > 1 else "again", 5)("t") == [("a", "r", "b")]
    assert calls == ["", "again"]

    def fails(t):
        raise ValueError("x")

    assert extraction.swarm([base, base, fails], extraction.majority)("t") == [("a", "r", "b")]
    assert extraction.swarm([base], None)("t") == []


def test_configuration():
    c = extraction.PipelineConfig.of({"chunk_size": 10, "chunk_overlap": 2, "unknown": 1})
    assert c.merged({"chunk_size": 20}).chunk_size == 20
    for bad in ({"chunk_size": 0}, {"chunk_size": 5, "chunk_overlap": 5}, {"max_workers": 0}, {"chunk_method": "x"}, {"scientific_domain": ""}):
        with pytest.raises(ValueError):
            extraction.PipelineConfig.of(bad)
    assert extraction.extractor_config({"extraction_type": "swarm", "swarm_size": 2}).swarm_size == 2
    for bad in ({}, {"extraction_type": "x"}, {"extraction_type": "swarm"}, {"extraction_type": "refine", "sleep": -1}, {"extraction_type": "swarm", "swarm_size": 2, "model_names": ["a"]}):
        with pytest.raises(ValueError):
            extraction.extractor_config(bad)


def test_hypotheses(spark):
    replies = hypothesis.ModelGenerator(lambda c: f"Title: T\nHypothesis Statement: {c} holds").run(spark.createDataFrame([("s1", "ctx")], "subgraph_id string, context string"))
    h = hypothesis.parsed(replies)
    r = h.first()
    assert r.title == "T" and r.statement == "ctx holds" and len(r.hypothesis_id) == 64
    assert json.loads(hypothesis.as_json(h).first().body)["text"] == "ctx holds"
    assert hypothesis.as_markdown(h.withColumn("references", F.array(F.lit("one")))).first().body.endswith("### 1. one")
    done = hypothesis.improve(spark.createDataFrame([("s", "c"), ("t", "cc")], "subgraph_id string, context string"), lambda c: c, {"n": lambda x: "ok"}, lambda x: "ACCEPT" if x.startswith("cc") else "no", lambda x: "c" + x.split("\n")[0], limit=1)
    assert {(r.subgraph_id, r.decision, r.iterations) for r in done.collect()} == {("t", "ACCEPT", 1), ("s", "ACCEPT", 2)}
    m = spark.createDataFrame([("c", "gpt-4o-mini-x", 2000, 2000), ("c", "gpt-4o", 1000, 0), ("c", "?", 9, 9)], "conversation string, model string, tokens_in long, tokens_out long")
    assert hypothesis.cost(m).first().cost == pytest.approx(0.0015 + 0.0025)


def test_store(spark, tmp_path):
    s = Registry(spark, str(tmp_path / "a")).get()
    s.save_file("i", "x.pdf", b"\x00\xff", "raw")
    assert s.get_file("i", "x.pdf", "raw") == b"\x00\xff"
    assert s.list_files("i") == ["raw/x.pdf"] and s.list_files("i", "raw") == ["x.pdf"] and s.list_files("none") == []
    s.save_file("i", "text/full.txt", b"f", "processed")
    s.save_file("i", "text/intro.txt", b"f", "processed")
    s.save_file("i", "a.json", b"{}", "processed")
    assert s.sections("i") == ["intro"] and s.processed("i") == ["a.json"]
    assert s.list_directory("i")["directories"] == ["processed", "raw"]
    assert s.delete_file("i", "x.pdf", "raw") and not s.delete_file("i", "x.pdf", "raw")
    with pytest.raises(FileNotFoundError):
        s.version("i")
    for v in ("baseline_9", "baseline_10"):
        s.create_version("i", v)
    assert s.version("i") == "baseline_9" and s.version("i", "baseline_10") == "baseline_10" and s.next_version("i") == "baseline_11"
    for bad in (lambda: s.version("i", "no"), lambda: s.create_version("i", "a/b"), lambda: s.save_file("i", "x", b"", "other"), lambda: Registry(spark, "x").get("no")):
        with pytest.raises(ValueError):
            bad()
    assert {r.item_id for r in Store(spark, str(tmp_path / "a")).files("*.json").collect()} == {"i"}
    assert subgraph_name("x/" + subgraph_file("n")) == "n"


def test_triplet_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('node_1,node_2,edge,chunk_id\n"a, b",c,r,k_0\n')
    t = readers.triplets_csv(spark, str(tmp_path / "t.csv"))
    r = t.df.first()
    assert (r.node_1, r.edge, r.node_2, r.metadata) == ("a, b", "r", "c", {"chunk_id": "k_0"})
    (tmp_path / "bad.csv").write_text("node_1,edge\na,b\n")
    with pytest.raises(ValueError):
        readers.triplets_csv(spark, str(tmp_path / "bad.csv"))
    writers.triplets_csv(t, str(tmp_path / "out"))
    assert readers.triplets_csv(spark, str(tmp_path / "out")).df.first().metadata == {"chunk_id": "k_0"}
    writers.triplets_markdown(t, str(tmp_path / "md"))
    for item, v, body in (("i", "baseline_9", "a,b,r,k_1"), ("i", "baseline_10", "a,b,old,k_0"), ("j", "baseline_10", "c,d,s,\"{'x': 1}\"")):
        p = tmp_path / "ds" / item / "kg" / v
        p.mkdir(parents=True)
        (p / "triplets.csv").write_text("node_1,node_2,edge,metadata\n" + body + "\n")
    got = {(r.item_id, r.edge): r.metadata for r in readers.dataset_triplets(spark, str(tmp_path / "ds")).collect()}
    assert got == {("i", "r"): {"chunk_id": "k_1"}, ("j", "s"): {"x": "1"}}
    assert readers.dataset_triplets(spark, str(tmp_path / "ds"), "baseline_9").count() == 1
    with pytest.raises(ValueError):
        readers.dataset_triplets(spark, str(tmp_path / "ds"), "baseline_9", skip_errors=False)
    for item in ("i", "j"):
        (tmp_path / "ds" / item / "metadata.json").write_text(json.dumps({"doi": item}))
    assert readers.items_json(spark, str(tmp_path / "ds"), seed=1).count() == 2
    assert readers.items_json(spark, str(tmp_path / "ds"), without_version="baseline_9").first().item_id == "j"


def test_graph_files(spark, tmp_path):
    g = Graph.build(Triplets.of(spark, [("a", "r", "b", {"k": "v"}), ("b", "s", "c")]), domain="d")
    writers.graph_json(g, str(tmp_path / "g"))
    h = readers.graph_json(spark, str(tmp_path / "g"), "e")
    assert h.describe() == g.describe() and {tuple(r.domains) for r in h.nodes.collect()} == {("e",)}
    assert sorted(map(repr, (r.metadata for r in h.triplets().df.collect()))) == sorted(map(repr, ({"k": "v"}, {})))
    assert readers.graph_json(spark, str(tmp_path / "g"), "e", max_items=1).number_of_edges() == 1
    assert {tuple(r.domains) for r in readers.graph_json(spark, str(tmp_path / "g"), "d", preserve_domains=True).edges.collect()} == {("d",)}
    with pytest.raises(ValueError):
        writers.graph_document(Graph.empty(spark))
    assert writers.edge_dump(g).count() == 2
    from tessergraph.operators.subgraph import Subgraphs

    p = spark.createDataFrame([("p", "a", "c", ["a", "b", "c"])], "path_id string, start string, end string, path array<string>")
    Subgraphs(g, p).documents().select(F.col("json").alias("value")).coalesce(1).write.text(str(tmp_path / "s"))
    paths, nodes, edges = readers.subgraph_json(spark, str(tmp_path / "s"))
    assert paths.first().path == ["a", "b", "c"] and nodes.count() == 3 and edges.count() == 2
    (tmp_path / "e.json").write_text(json.dumps({"embedding_provider": "p", "model_name": "m", "distance_metric": "cosine", "embeddings": {"a": [1.0]}}))
    assert readers.embedding_cache(spark, str(tmp_path / "e.json"), "p", "m")[1] == "cosine"
    with pytest.raises(ValueError):
        readers.embedding_cache(spark, str(tmp_path / "e.json"), "p", "other")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = writers.updated(table, "k", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "c")] and readers.exists(new, "v", "c")


def test_web_rows(spark):
    p = spark.createDataFrame([(1, '<title>T</title><table><tr><td>a <b>x</b></td><td>2</td></tr></table><a href="u">')], "page_id long, html string")
    assert readers.html_rows(p).first().cells == ["a x", "2"] and tuple(readers.html_links(p).first()) == (1, "T", 1)
    y = readers.yearly(spark.createDataFrame([("x\n2001,0.5,3\n1999,0.1,2",)], "text string")).collect()
    assert [r.year for r in y] == [1999, 2001]


def test_stream_grows_a_graph_and_repeats_count_once(spark, tmp_path):
    kind = "triplet_ord long, node_1 string, edge string, node_2 string, metadata map<string,string>"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    one = spark.createDataFrame([(0, "a", "r", "b", {"k": "1"}), (1, "b", "r", "c", {})], kind)
    one.write.parquet(src)
    stream = lambda: spark.readStream.schema(kind).parquet(src)
    incremental.grow(stream(), out, str(tmp_path / "cp")).awaitTermination()
    one.union(spark.createDataFrame([(2, "c", "s", "a", {})], kind)).write.mode("append").parquet(src)
    incremental.grow(stream(), out, str(tmp_path / "cp")).awaitTermination()
    g = incremental.grown(spark, out, "d")
    assert g.number_of_edges() == 3 and g.triplets().count() == 3


def test_windowed_relation_counts(spark, tmp_path):
    kind = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    src = str(tmp_path / "ev")
    spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id*600) AS ts, id AS user_id, if(id % 2 = 0, 'a', 'b') AS event_type, 1.0D AS value, '{\"k\": 3}' AS props FROM range(20)").write.parquet(src)
    q = incremental.relation_counts(spark.readStream.schema(kind).parquet(src)).writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT relation, sum(n) AS n FROM counted GROUP BY relation").collect()
    assert sum(r.n for r in rows) >= 12
    t = incremental.event_triplets(spark.read.parquet(src)).orderBy("triplet_ord").first()
    assert (t.node_1, t.edge, t.node_2) == ("U0", "a", "K3")


def test_command_line_from_texts_to_subgraphs(spark, tmp_path, capsys):
    from tessergraph import cli

    d = tmp_path / "data" / "i"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("Alpha binds Beta. beta blocks Gamma.")
    cli.main(["extract", "--data", str(tmp_path / "data"), "--output", str(tmp_path / "t")])
    kg = d / "kg" / "baseline_1"
    kg.mkdir(parents=True)
    rows = readers.triplets_csv(spark, str(tmp_path / "t")).df.collect()
    assert {(r.node_1, r.edge, r.node_2) for r in rows} == {("Alpha", "binds", "Beta"), ("beta", "blocks", "Gamma")}
    (kg / "triplets.csv").write_text("node_1,node_2,edge,chunk_id\n" + "".join(f"{r.node_1},{r.node_2},{r.edge},c\n" for r in rows))
    cli.main(["graph", "--data", str(tmp_path / "data"), "--output", str(tmp_path / "g"), "--domain", "d"])
    g = cli.load(spark, str(tmp_path / "g"), "d")
    assert g.number_of_nodes() == 3 and g.number_of_edges() == 2
    cli.main(["subgraph", "--graph", str(tmp_path / "g"), "--output", str(tmp_path / "s"), "--num-subgraphs", "1"])
    assert spark.read.text(str(tmp_path / "s")).count() == 1
    cli.main(["graph-stats", "--graph", str(tmp_path / "g")])
    assert "relation_types" in capsys.readouterr().out


def test_models_prompts_and_longer_loop(spark, tmp_path):
    from tessergraph.operators import models

    m = models.Models(a=str.upper)
    m.register("b", str.lower)
    assert m.get("a")("x") == "X" and m.get()("X") == "x"
    with pytest.raises(ValueError):
        m.get("c")
    p = models.Prompts({"q": "Tell {who} of {what}."})
    assert p.get("q", who="A", what="B") == "Tell A of B."
    assert one(spark, p.column("q", who=F.lit("A"), what=F.lit(None)))[0] == "Tell A of ."
    with pytest.raises(ValueError):
        p.get("none")
    (tmp_path / "p.yaml").write_text("q: 'Hi {x}'\n")
    assert models.Prompts.from_yaml(str(tmp_path / "p.yaml")).get("q", x=1) == "Hi 1"
    start = spark.createDataFrame([("s", "ctx")], "subgraph_id string, context string")
    tried = models.novel(start, lambda c: "h+" if "dull" in c else "h", lambda h: "ACCEPT" if "+" in h else "dull").first()
    assert (tried.hypothesis, tried.tries) == ("h+", 2)
    done = models.reviewed(start, lambda c: "h", lambda h: "dull", lambda h: "m", {"nice": lambda h: "good", "rude": lambda h: "bad"}, lambda v: "ACCEPT" if "nice: good\nrude: bad" in v else "no", lambda h: h).first()
    assert done.hypothesis == "h\nMethod: m" and done.decision == "ACCEPT" and done.iterations == 1


def test_prices_are_of_the_exact_model(spark):
    names = ["o3-mini-2025-01-31", "o3-mini", "o1-mini", "gpt-4o-2024-08-06", "gpt-4o-mini-2024-07-18", "gpt-4o-audio", None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(names)], "i int, model string")
    got = {r.i: r.c for r in df.select("i", text.message_cost(F.col("model"), F.lit(2000), F.lit(1000)).alias("c")).collect()}
    assert got == {0: 0.0044, 1: 0.0044, 2: 0.0, 3: 0.015, 4: 0.0009, 5: 0.0, 6: 0.0}


def test_embedding_cache_comes_back_as_it_was_written(spark, tmp_path):
    vecs = spark.createDataFrame([("a b", [0.25, -1.0]), ("é", [3.0, 0.0])], "text string, vec array<double>")
    writers.embedding_cache(vecs, str(tmp_path / "c"), "own", "m1", "euclidean")
    rows, metric = readers.embedding_cache(spark, str(tmp_path / "c"), "own", "m1")
    assert metric == "euclidean" and {r.text: r.vec for r in rows.collect()} == {"a b": [0.25, -1.0], "é": [3.0, 0.0]}
    with pytest.raises(ValueError):
        readers.embedding_cache(spark, str(tmp_path / "c"), "own", "m2")
    with pytest.warns(UserWarning):
        readers.embedding_cache(spark, str(tmp_path / "c"), "other", "m1")


def test_chosen_texts(spark):
    items = spark.createDataFrame([("i", "whole", "clean", ["a", "b"], None), ("j", None, "c", [], ["d"])], "item_id string, full_text string, clean_full_text string, sections array<string>, clean_sections array<string>")
    got = {g: [(r.chunk_id, r.text) for r in text.chunk_arrays(text.chosen_text(items, g)).orderBy("chunk_id").collect()] for g in text.GETTERS}
    assert got == {"full_text": [("i_0", "whole")], "clean_full_text": [("i_0", "clean"), ("j_0", "c")], "sections": [("i_0", "a"), ("i_1", "b")], "clean_sections": [("j_0", "d")]}
    with pytest.raises(ValueError):
        text.chosen_text(items, "title")
