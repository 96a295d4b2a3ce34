"""Registry of the library's queries over the driver's tables, each with its SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmatch.functions import bits, codec, distance
from lexmatch.operators import automaton, fuzzy, layout, ordering
from lexmatch.plans import sql
from lexmatch.plans.stages import shared_dir, spread, written
from lexmatch.sources import corpus, export, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: One-word dictionaries, a query, the bound k and whether it matches; "-" is an ordinary letter.
SINGLE_EDITS = [
    *[(a, b, 1, True) for a, b in (("ab--", "ba--"), ("-ab-", "-ba-"), ("--ab", "--ba"), ("--", "a--"), ("--", "-a-"), ("--", "--a"), ("abc", "bc"), ("abc", "ac"), ("abc", "ab"), ("abc", "xbc"), ("abc", "axc"), ("abc", "abx"))],
    *[(a, b, 2, False) for a, b in (("ab--", "bxa--"), ("-ab-", "-bxa-"), ("--ab", "--bxa"))],
]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' dictionary."""
    return corpus.dictionary(spread(read(spark, sf_dir, "documents").select("text")))


def held(spark: SparkSession, sf_dir: str) -> fuzzy.FuzzyDictionary:
    """The documents' dictionary as a table in the shared folder, for queries that read it more than once."""
    return fuzzy.FuzzyDictionary(written(vocabulary(spark, sf_dir), "dictionary"), persist=False)


def small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's dictionary, whose graph has some thousands of nodes: that of the searches, which run in one task each."""
    return corpus.dictionary(read(spark, sf_dir, "benchmark"))


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(query): every word of the benchmark with a mistake, each once."""
    return corpus.dictionary(read(spark, sf_dir, "benchmark")).select(corpus.noisy("term").alias("query")).distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = spark.createDataFrame([("adventures",)], "query string")
    return fuzzy.lookup(word, vocabulary(spark, sf_dir), 3)


# dictionaries and workloads


@query("dict_build", f"select term, freq from ({sql.VOCABULARY})")
def dict_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merged(vocabulary(spark, sf_dir))


def _corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lines.unionByName(vocabulary(spark, sf_dir).select(F.concat_ws(" ", "term", "freq").alias("value")))


@query("dict_corpus_parse", sql.CORPUS_PARSE)
def dict_corpus_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.merged(corpus.corpus_lines(_corpus_lines(spark, sf_dir)))


@query("dict_strict_order_violations", sql.ORDER_VIOLATIONS)
def dict_strict_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    lists = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("list_id"), F.posexplode(found).alias("pos", "term"))
    return corpus.order_violations(lists).select("list_id", F.col("pos").cast("bigint").alias("pos"), "term", "previous")


@query("query_parse", sql.QUERY_PARSE)
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "conversations").select(F.explode(F.split("text", "\n")).alias("value"))
    words = corpus.dictionary(read(spark, sf_dir, "benchmark")).select(F.concat_ws(" ", corpus.noisy("term"), "term", distance.osa(corpus.noisy("term"), "term")).alias("value"))
    return corpus.workload_lines(lines.unionByName(words))


# lookups


@query("lookup_exact_k0", sql.EXACT)
def lookup_exact_k0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 0)


@query("lookup_osa_k1", sql.lookup(1))
def lookup_osa_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 1)


@query("lookup_osa_k2", sql.lookup(2))
def lookup_osa_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 2)


@query("lookup_osa_k3", sql.lookup(3))
def lookup_osa_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 3)


@query("lookup_pairs_k2", sql.lookup(2))
def lookup_pairs_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 2, "pairs")


@query("lookup_deletions_k2", sql.lookup(2))
def lookup_deletions_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the plan for large workloads."""
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 2, "deletions")


@query("lookup_deletions_k3", sql.lookup(3))
def lookup_deletions_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.lookup(workload(spark, sf_dir), vocabulary(spark, sf_dir), 3, "deletions")


@query("lookup_single_term", sql.SINGLE)
def lookup_single_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = spark.createDataFrame([("adventures",), ("the",), ("tion",)], "query string")
    return fuzzy.lookup(word, vocabulary(spark, sf_dir), 3)


@query("lookup_batch_totals", sql.TOTALS)
def lookup_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.FuzzyDictionary(vocabulary(spark, sf_dir), persist=False).totals(workload(spark, sf_dir))


@query("lookup_report", sql.REPORT)
def lookup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of all queries for each k, and the terms within three edits of one word."""
    return held(spark, sf_dir).report(workload(spark, sf_dir), "adventures")


@query("lookup_matched", sql.matched("exists"))
def lookup_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.FuzzyDictionary(vocabulary(spark, sf_dir), persist=False).matched(workload(spark, sf_dir), 1)


@query("lookup_unmatched", sql.matched("not exists"))
def lookup_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.FuzzyDictionary(vocabulary(spark, sf_dir), persist=False).unmatched(workload(spark, sf_dir), 1)


@query("lookup_best", sql.BEST)
def lookup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy.FuzzyDictionary(vocabulary(spark, sf_dir), persist=False).best(workload(spark, sf_dir), 1)


@query("dictionary_lifecycle", f"select count(*)::bigint as words, true as kept, false as kept_after from ({sql.VOCABULARY})")
def dictionary_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dictionary is kept while it is open, and after it is closed."""
    with fuzzy.FuzzyDictionary(vocabulary(spark, sf_dir)) as words:
        n, kept = words.word_count, words.frame.storageLevel.useMemory
    return spark.createDataFrame([(n, kept, words.frame.storageLevel.useMemory)], "words bigint, kept boolean, kept_after boolean")


@query("osa_pairs", sql.OSA_PAIRS)
def osa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = corpus.dictionary(read(spark, sf_dir, "benchmark")).select("term", corpus.noisy("term").alias("noisy"))
    return words.select("term", "noisy", distance.osa("noisy", "term").alias("distance"), distance.within("noisy", "term", 2).alias("within_2"))


@query("osa_single_edit_cases", sql.single_edits(SINGLE_EDITS))
def osa_single_edit_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SINGLE_EDITS, "term string, query string, k int, expected boolean")
    at = lambda k: distance.within("query", "term", k).isNotNull()
    return rows.select("term", "query", "k", "expected", (F.col("term") == F.col("query")).alias("match_0"), F.when(F.col("k") == 1, at(1)).otherwise(at(2)).alias("match_k"))


@query("common_prefix_adjacent", sql.COMMON_PREFIX)
def common_prefix_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordering.ranked(vocabulary(spark, sf_dir).select("term"), ["term"], "at")
    before = placed.select(F.col("term").alias("previous"), (F.col("at") + 1).alias("at"))
    return placed.join(before, "at").select("term", "previous", distance.common_prefix_length("term", "previous").cast("bigint").alias("common"))


@query("log2_score", f"select term, freq, (length(bin(freq)) - 1)::bigint as score from ({sql.VOCABULARY})")
def log2_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("term", "freq", distance.floor_log2("freq").alias("score"))


# the automaton


def _automaton(dictionary: DataFrame) -> automaton.Automaton:
    return automaton.Automaton(written(dictionary, "dictionary"), keep=written)


@query("trie_prefix_counts", sql.automaton("select prefix, reachable::bigint as reachable, weight::bigint as weight, is_terminal from nodes"))
def trie_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.trie(vocabulary(spark, sf_dir)).select("prefix", "reachable", "weight", "is_terminal")


@query("dawg_state_stats", sql.automaton("select (select count(*) from nodes)::bigint as n_trie_nodes, (select count(*) from states)::bigint as n_states, (select count(*) from edges)::bigint as n_edges, (select count(*) from states where is_terminal)::bigint as n_terminals"))
def dawg_state_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _automaton(vocabulary(spark, sf_dir)).stats()


@query("dawg_states", sql.automaton("select state, is_terminal, reachable::bigint as reachable, level::int as level from states"))
def dawg_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _automaton(vocabulary(spark, sf_dir)).states.select("state", "is_terminal", "reachable", "level")


@query("dawg_edge_weights", sql.automaton("select src, label, dst, weight::bigint as weight from edges"))
def dawg_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _automaton(vocabulary(spark, sf_dir)).edges()


@query("dawg_scores", sql.automaton("select state, own_score, score from scores"))
def dawg_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _automaton(vocabulary(spark, sf_dir)).scores()


@query("dawg_child_order", sql.automaton("select src, label, dst, (row_number() over (partition by src order by score desc, label) - 1)::bigint as sibling from edges join scores on dst = scores.state"))
def dawg_child_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.child_order(_automaton(vocabulary(spark, sf_dir)))


@query("dawg_topological_order", sql.automaton("select state, level::int as level, order_id from topo"))
def dawg_topological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.topological(_automaton(vocabulary(spark, sf_dir)))


@query("mph_index", sql.automaton("select term, freq, idx from ranks"))
def mph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(vocabulary(spark, sf_dir), "dictionary")
    return ordering.word_index(words)


@query("mph_get_index", sql.automaton(f"select query, coalesce(idx, -1)::bigint as idx from ({sql.WORKLOAD}) w left join ranks on term = query"))
def mph_get_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).get_index(workload(spark, sf_dir))


@query("mph_get_word", sql.automaton("select item_id::bigint as idx, term from benchmark join ranks on item_id = idx"))
def mph_get_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir).get_word(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx")))


@query("mph_bijection_violations", "select ''::varchar as term, 0::bigint as idx, 0::bigint as back where false")
def mph_bijection_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes whose word doesn't lead back to them."""
    words = held(spark, sf_dir)
    there = words.get_word(spark.range(words.word_count).select(F.col("id").alias("idx")))
    back = words.get_index(there.select(F.col("term").alias("query"), F.col("idx").alias("was")))
    return back.where("idx <> was").select(F.col("query").alias("term"), F.col("was").alias("idx"), F.col("idx").alias("back"))


@query("csr_nodes", sql.automaton("select order_id, first_edge, degree, reachable::bigint as reachable, is_terminal from csr_nodes"))
def csr_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.CompressedRows(_automaton(vocabulary(spark, sf_dir))).nodes()


@query("csr_edges", sql.automaton("select edge_id, src_order, dst_order, label, weight::bigint as weight from csr_edges"))
def csr_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.CompressedRows(_automaton(vocabulary(spark, sf_dir))).edges


@query("csr_delta_offsets", sql.automaton("select order_id, first_edge, (first_edge - lag(first_edge, 1, 0) over (order by order_id))::bigint as delta from csr_nodes"))
def csr_delta_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.delta_offsets(written(_rows(spark, sf_dir).nodes(), "nodes"))


# layout


def _rows(spark: SparkSession, sf_dir: str, words: Query = vocabulary) -> ordering.CompressedRows:
    return ordering.CompressedRows(_automaton(words(spark, sf_dir)))


@query("arrangement_cost", sql.automaton("select sum(abs(src_order - dst_order) * weight)::bigint as cost from csr_edges"))
def arrangement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.arrangement_cost(_rows(spark, sf_dir).edges)


@query("cache_arrangement_cost", sql.automaton("select sum(case when src_order // 16 <> dst_order // 16 then weight else 0 end)::bigint as cost from csr_edges"))
def cache_arrangement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cache_arrangement_cost(_rows(spark, sf_dir).edges)


@query("arranged_edges", sql.automaton("select (n - 1 - src_order)::bigint as src_order, (n - 1 - dst_order)::bigint as dst_order, label, weight::bigint as weight from csr_edges, (select count(*) as n from states)"))
def arranged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    n = rows.order.count()
    back = rows.order.select((n - 1 - F.col("order_id")).alias("position"), F.col("order_id").alias("node_id"))
    return layout.arrange(rows.edges, layout.checked(back, n))


@query("undirected_graph", sql.automaton("select a, b, sum(weight)::bigint as weight from (select src_order as a, dst_order as b, weight from csr_edges union all select dst_order, src_order, weight from csr_edges) group by a, b"))
def undirected_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.undirected(_rows(spark, sf_dir).edges)


def _contracted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph's links, and the nodes that stay: the root and its children."""
    edges = written(_rows(spark, sf_dir).edges.select(F.col("src_order").alias("src"), F.col("dst_order").alias("dst")), "links")
    return edges, written(edges.where("src = 0").select(F.col("dst").alias("node")).union(spark.range(1).select(F.col("id").alias("node"))).distinct(), "fixed")


@query("coarsened_graph", sql.coarsened(sql.COARSE_SIZES))
def coarsened_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after contraction of nodes with 1 to 9 parents."""
    return layout.shrunk(*_contracted(spark, sf_dir))


@query("coarsened_down_graph", sql.coarsened(sql.COARSE_SIZES, "dst", "src"))
def coarsened_down_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by children."""
    return layout.shrunk(*_contracted(spark, sf_dir), down=True)


@query("coarsened_links", sql.coarsened(sql.COARSE_LINKS, last=1))
def coarsened_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph's JSON after contraction of all nodes with one parent."""
    edges, fixed = _contracted(spark, sf_dir)
    return export.d3_links(layout.coarsen(edges, fixed, 1), "src", "dst")


@query("d3_nodes", sql.automaton("""select '{"x":' || order_id || ',"y":' || order_id || '}' as json from topo"""))
def d3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.d3_nodes(_rows(spark, sf_dir).order)


@query("d3_links", sql.automaton("""select distinct '{"source":' || src_order || ',"target":' || dst_order || '}' as json from csr_edges"""))
def d3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.d3_links(_rows(spark, sf_dir).edges)


# searches of a layout, which run in one task each, over the benchmark's graph

#: Moves of a registered search; the operator's default is the reference's schedule, hours or days of moves.
MOVES = 100_000


@query("anneal_layout")
def anneal_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, small)
    return layout.annealed(written(rows.nodes(), "nodes"), rows.edges, "cache", moves=MOVES)


@query("anneal_topological_cache")
def anneal_topological_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For few cache lines crossed among topological orders."""
    rows = _rows(spark, sf_dir, small)
    return layout.annealed(written(rows.nodes(), "nodes"), rows.edges, "topological_cache", moves=MOVES)


@query("spectral_layout")
def spectral_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, small)
    return layout.spectral(written(rows.nodes(), "nodes"), rows.edges)


@query("cache_aware_pipeline")
def cache_aware_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost before, search, renumbering, cost after."""
    rows = _rows(spark, sf_dir, small)
    found = written(layout.best_arrangement(layout.annealed(written(rows.nodes(), "nodes"), rows.edges, "cache", moves=MOVES)), "best")
    after = layout.cache_arrangement_cost(layout.arrange(rows.edges, found)).withColumnRenamed("cost", "cost_after")
    return layout.cache_arrangement_cost(rows.edges).withColumnRenamed("cost", "cost_before").crossJoin(after)  # one row each


@query("ordering_pipeline")
def ordering_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of a topological search, the spectral order and a free search from there, one row per step."""
    rows = _rows(spark, sf_dir, small)
    nodes, edges = written(rows.nodes(), "nodes"), rows.edges
    first = written(layout.best_arrangement(layout.annealed(nodes, edges, "topological", 2, MOVES)), "first")
    second = written(layout.spectral(nodes, edges), "second")
    moved = written(layout.arrange(edges, second), "moved")
    place = nodes.join(second.select(F.col("node_id").alias("order_id"), "position"), "order_id").select(F.col("position").alias("order_id"), "is_terminal")
    third = written(layout.best_arrangement(layout.annealed(place, moved, "ordering", 2, MOVES)), "third")
    steps = {"ids": edges, "topological": layout.arrange(edges, first), "spectral": moved, "ordering": layout.arrange(moved, third)}
    out = None
    for name, graph in steps.items():
        row = layout.arrangement_cost(graph).select(F.lit(name).alias("step"), "cost")
        out = row if out is None else out.unionByName(row)
    return out


# storage and numbers


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ordering.CompressedRows]:
    words = written(vocabulary(spark, sf_dir), "dictionary")
    automaton_ = automaton.Automaton(words, keep=written)
    return ordering.word_index(words, automaton_), ordering.CompressedRows(automaton_)


@query("store_round_trip", sql.automaton("select term, freq, idx from ranks"))
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of an index that was saved and loaded."""
    words, rows = _index(spark, sf_dir)
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    store.save(path, dictionary=words, nodes=rows.nodes(), edges=rows.edges)
    return store.load(spark, path)["dictionary"]


@query("binary_round_trip", sql.automaton("select term, freq, idx from ranks"))
def binary_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of an index that was written to one binary file and read back."""
    words, rows = _index(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}.bin"
    store.write_file(spark, path, store.export_pieces(written(rows.nodes(), "nodes"), rows.edges, words))
    return store.import_dictionary(spark, path).drop("path")


@query("binary_nodes", sql.automaton("select order_id, first_edge, degree, reachable::bigint as reachable from csr_nodes"))
def binary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of such a file."""
    words, rows = _index(spark, sf_dir)
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}.bin"
    store.write_file(spark, path, store.export_pieces(written(rows.nodes(), "nodes"), rows.edges, words))
    return store.import_nodes(spark, path).drop("path")


@query("codec_sizes", sql.CODEC)
def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that each frequency takes as a variable-length number, unsigned and negated signed, and what is read back."""
    counts = vocabulary(spark, sf_dir).select("freq").distinct()

    def sizes(batches):
        for batch in batches:
            plain, signed = [codec.pack_unsigned(x) for x in batch.freq], [codec.pack_signed(-x) for x in batch.freq]
            yield batch.assign(unsigned=[*map(len, plain)], signed=[*map(len, signed)], unsigned_back=[codec.Cursor(x).unsigned() for x in plain], signed_back=[codec.Cursor(x).signed() for x in signed])

    return counts.mapInPandas(sizes, "freq bigint, unsigned bigint, signed bigint, unsigned_back bigint, signed_back bigint")


@query("codec_arrays", sql.CODEC_ARRAYS)
def codec_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MD5 of the bytes of the format's arrays and text, of the words of equal length and first two letters, and whether all are read back."""
    block = F.concat(F.left("term", F.lit(2)), F.length("term").cast("string")).alias("block")
    lists = vocabulary(spark, sf_dir).groupBy(block).agg(F.sort_array(F.collect_list(F.struct("term", "freq"))).alias("words"))
    lists = lists.select("block", "words.term", "words.freq")

    def pack(batches):
        for batch in batches:
            rows = []
            for block, terms, counts in zip(batch.block, batch.term, batch.freq):
                counts = [int(x) for x in counts]
                signed, sums, text = [-x if i % 2 else x for i, x in enumerate(counts)], [*accumulate(counts)], "".join(terms)
                made = codec.pack_unsigned_array(counts), codec.pack_signed_array(signed), codec.pack_ascending_array(sums), codec.pack_text(text)
                at = codec.Cursor(b"".join(made))
                back = (at.unsigned_array(), at.signed_array(), at.ascending_array(), at.text()) == (counts, signed, sums, text)
                rows.append((block, *[hashlib.md5(x).hexdigest() for x in made], back))
            yield pd.DataFrame(rows, columns=["block", "unsigned", "signed", "ascending", "text", "back"])

    return lists.mapInPandas(pack, "block string, unsigned string, signed string, ascending string, text string, back boolean")


@query("math_utils", sql.MATH)
def math_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x, y = F.col("o_orderkey"), F.col("o_custkey").cast("bigint")
    return orders.select("o_orderkey", bits.positive_or_zero(x - y).alias("positive"), bits.absolute(x - y).alias("absolute"), bits.smaller(x, y).alias("smaller"), bits.rotate_right_32(x, 5).alias("rotated"), bits.swap_outer_16(x).alias("swapped"))
