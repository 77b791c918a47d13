"""Alignment of extracted triples with the names of the graph: candidates by vector search, swapped and relaxed, and the gold lists for a model.

Triples are rows (qid, place, head, relation, tail): anchors have their index as place, the search triple has ``SEARCH``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import providers as M
from . import match, similarity

#: Place of the search triple, behind all anchors.
SEARCH = 1 << 20


def vocabulary(facts: DataFrame, embedder: M.Embedder) -> dict[str, DataFrame]:
    """Names of entities and relations with their vectors of length 1, (id, v). Store them where more than one search is made."""
    ents = facts.select(F.col("head").alias("id")).union(facts.select("tail")).where("id IS NOT NULL").distinct()
    rels = facts.select(F.col("relation").alias("id")).where("id IS NOT NULL").distinct()
    vectors = lambda names: M.embed(names, "id", embedder, "v").select("id", similarity.normalized(F.col("v")).alias("v"))
    return {"entity": vectors(ents), "relation": vectors(rels)}


def near_names(triples: DataFrame, slots: tuple[str, ...], names: DataFrame, embedder: M.Embedder, least: float, k: int = 64, prune: bool = True) -> DataFrame:
    """(text, name, sim): for each different known text of the slots its ``k`` nearest names of ``least`` or more; with ``prune`` only the confident ones where there are any."""
    texts = reduce(DataFrame.union, [triples.select(F.col(s).alias("query_id")) for s in slots]).where(~X.is_unknown(F.col("query_id"))).distinct()
    queries = M.embed(texts, "query_id", embedder, "v").select("query_id", similarity.normalized(F.col("v")).alias("v"))
    found = similarity.top_k(queries, names, k, least)
    found = similarity.prune_confident(found) if prune else found
    return found.select(F.col("query_id").alias("text"), F.col("id").alias("name"), F.col("score").alias("sim"))


def candidates(triples: DataFrame, facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples of the graph whose known slots are near those asked for, with a similarity for each slot (1 where unknown) and their sum.

    One equi join on the head's names, else on the tail's, else on the relation's; the other known slots are checked after it. A triple without a known slot finds nothing.
    """
    asked = triples.select("qid", "place", *(F.when(~X.is_unknown(F.col(s)), F.col(s)).alias(f"q_{s}") for s in match.SLOTS))
    stored = facts.select(*match.SLOTS).distinct()
    names = {"head": entities, "relation": relations, "tail": entities}

    def side(slot: str) -> DataFrame:
        return names[slot].select(F.col("text").alias("_text"), F.col("name").alias("_name"), F.col("sim").alias(f"{slot[0]}_sim"))

    def checked(found: DataFrame, slot: str) -> DataFrame:
        out = found.join(side(slot), (F.col(f"q_{slot}") == F.col("_text")) & (F.col(slot) == F.col("_name")), "left").drop("_text", "_name")
        out = out.where(F.col(f"q_{slot}").isNull() | F.col(f"{slot[0]}_sim").isNotNull())
        return out.withColumn(f"{slot[0]}_sim", F.coalesce(f"{slot[0]}_sim", F.lit(1.0)))

    parts, rest = [], asked
    for n, slot in enumerate(("head", "tail", "relation")):
        named = rest.where(F.col(f"q_{slot}").isNotNull()).join(side(slot), F.col(f"q_{slot}") == F.col("_text")).drop("_text")
        found = named.join(stored, F.col("_name") == F.col(slot)).drop("_name")
        for other in match.SLOTS:
            found = found if other == slot else checked(found, other)
        parts.append(found.select("qid", "place", *(f"q_{s}" for s in match.SLOTS), *match.SLOTS, "h_sim", "r_sim", "t_sim"))
        rest = rest.where(F.col(f"q_{slot}").isNull())
    return reduce(DataFrame.unionByName, parts).withColumn("score_sum", F.col("h_sim") + F.col("r_sim") + F.col("t_sim"))


def similar(triples: DataFrame, facts: DataFrame, words: dict[str, DataFrame], embedder: M.Embedder, least: float, cap: int, prune: bool = False) -> DataFrame:
    """The ``cap`` best facts of each triple whose known slots are ``least`` or more similar, as columns of ``match.exact``: qid, place, those of ``facts`` and the scores."""
    ents, rels = near_names(triples, ("head", "tail"), words["entity"], embedder, least, prune=prune), near_names(triples, ("relation",), words["relation"], embedder, least, prune=prune)
    found = candidates(triples, facts, ents, rels).withColumn("anchor_type", X.anchor_type(*(F.col(f"q_{s}") for s in match.SLOTS))).drop(*(f"q_{s}" for s in match.SLOTS))
    others = [F.col(c) for c in facts.columns if c not in match.SLOTS]
    best = Window.partitionBy("qid", "place").orderBy(F.desc("score_sum"), *match.SLOTS, *others)
    return found.join(facts, list(match.SLOTS)).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= cap).drop("_n")


def cascade(triples: DataFrame, facts: DataFrame, entities: DataFrame, relations: DataFrame, high: float = 0.4) -> DataFrame:
    """Candidates of the first search that finds any: as asked, then with head and tail swapped, at ``high``; then both at the floor of the names.

    Each direction is searched once; whether a candidate reaches ``high`` tells its search. ``branch`` counts them from 0.
    """
    def direction(rows: DataFrame, swapped: bool) -> DataFrame:
        strong = F.least("h_sim", "r_sim", "t_sim") >= high
        found = candidates(rows, facts, entities, relations).withColumn("swapped", F.lit(swapped))
        return found.withColumn("branch", F.when(strong, 0).otherwise(2) + F.lit(int(swapped)))

    both = direction(triples, False).unionByName(direction(match.flipped(triples), True))
    least = F.min("branch").over(Window.partitionBy("qid", "place"))
    return both.withColumn("_least", least).where("branch = _least").drop("_least")


def gold_lists(triples: DataFrame, found: DataFrame, cap: int = 10) -> DataFrame:
    """(qid, gold_entities, gold_relations, gold_triples, problem): the first ``cap`` different names and anchor triples of the candidates, best first.

    An anchor without candidates gives its own slots. ``problem`` is set by the last anchor or the search triple being without any.
    """
    key = ["qid", "place"]
    lost = triples.join(found.select(*key).distinct(), key, "left_anti")
    own = lost.where(F.col("place") < SEARCH).select(*key, *match.SLOTS, *(F.col(s).alias(f"q_{s}") for s in match.SLOTS), F.lit(3.0).alias("score_sum"), F.lit(False).alias("swapped"))
    rows = found.select(*key, *match.SLOTS, *(f"q_{s}" for s in match.SLOTS), "score_sum", "swapped").unionByName(own)
    search = F.col("place") == SEARCH
    turned = lambda a, b, test: F.when(test, F.col(b)).otherwise(F.col(a))
    # Names of the search triple come as it asks for them, those of anchors as the graph has them; triples always as asked for.
    first, second = turned("head", "tail", F.col("swapped") & search), turned("tail", "head", F.col("swapped") & search)
    q_first, q_second = turned("q_head", "q_tail", F.col("swapped") & search), turned("q_tail", "q_head", F.col("swapped") & search)
    order = F.struct("place", -F.col("score_sum"), *match.SLOTS)
    entity = F.explode(F.array(F.struct(F.lit(0).alias("n"), first.alias("name"), q_first.alias("q")), F.struct(F.lit(1).alias("n"), second.alias("name"), q_second.alias("q"))))
    named = rows.select("qid", order.alias("o"), entity.alias("e")).where("e.q IS NOT NULL AND e.name IS NOT NULL").select("qid", F.struct("o", "e.n").alias("o"), F.col("e.name").alias("x"))
    linked = rows.where(search | F.col("q_relation").isNotNull()).select("qid", order.alias("o"), F.col("relation").alias("x"))
    whole = rows.where(~search).select("qid", order.alias("o"), F.array(turned("head", "tail", F.col("swapped")), F.col("relation"), turned("tail", "head", F.col("swapped"))).alias("x"))

    def firsts(df: DataFrame, name: str) -> DataFrame:
        least = df.groupBy("qid", "x").agg(F.min("o").alias("o"))
        best = least.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).where(F.col("n") <= cap)
        return best.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias(name))

    last = triples.where(F.col("place") < SEARCH).groupBy("qid").agg(F.max("place").alias("place"))
    told = triples.where(F.col("place") == SEARCH).select(*key).union(last.select(*key))
    problem = lost.select(*key).join(told, key, "left_semi").select("qid").distinct().withColumn("problem", F.lit(True))
    out = triples.select("qid").distinct()
    for part in (firsts(named, "gold_entities"), firsts(linked, "gold_relations"), firsts(whole, "gold_triples"), problem):
        out = out.join(part, "qid", "left")
    empty = F.array().cast("array<string>")
    return out.select("qid", F.coalesce("gold_entities", empty).alias("gold_entities"), F.coalesce("gold_relations", empty).alias("gold_relations"), F.coalesce("gold_triples", F.array().cast("array<array<string>>")).alias("gold_triples"), F.coalesce("problem", F.lit(False)).alias("problem"))


def turned_search(anchors: Column, search: Column) -> Column:
    """The search triple, turned where the anchors of its relation have its known entity on the other side only. Names are compared without case and outer space."""
    triple = lambda t: F.struct(*(F.lower(F.trim(F.get(t, F.lit(k)))).alias(s) for k, s in enumerate(match.SLOTS)))
    asks = (F.get(search, F.lit(0)) == "?") != (F.get(search, F.lit(2)) == "?")
    known = F.filter(anchors, lambda a: (F.get(a, F.lit(0)) != "?") & (F.get(a, F.lit(2)) != "?"))
    turn = asks & similarity.search_orientation(F.transform(known, triple), triple(search))
    return F.when(F.coalesce(turn, F.lit(False)), F.reverse(search)).otherwise(search)
