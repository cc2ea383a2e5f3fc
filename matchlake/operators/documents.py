"""Match events -> statistical profiles in five tiers -> numbered text documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import written

PART_ROWS = 100_000
TIERS = ("weapon_map_profile", "map_overview", "hotspot_zone", "round_type_profile", "weapon_global_profile")


#: The columns that tiers group by, in three sets: each event counts once in each.
PARTS = {
    "weapons": ("map", "event_type", "weapon", "hitbox", "att_side"),
    "squares": ("map", "event_type", "weapon", "att_side", "nade", "grid_x", "grid_y"),
    "rounds": ("map", "event_type", "round_type", "winner_side"),
}
#: What tiers add up, and what they take the least or the greatest of.
SUMS = ("n", "hp_dmg", "arm_dmg", "round_secs", "timed", "ct_eq", "t_eq", "eq_n")
LEAST, GREATEST = ("src_ord", "hp_ord"), ("hp_max",)


def prepared(events: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Cleaned cells and numbers, a row an event; absent columns are null. `max_rows` keeps the first rows in source order."""
    for c in ("event_type", "file", "round", "map", "source_file"):
        if c not in events.columns:
            raise ValueError(f"events need a column {c}")
    cells = ("map", "weapon", "hitbox", "att_side", "nade", "winner_side", "round_type")
    numbers = ("hp_dmg", "arm_dmg", "att_pos_x", "att_pos_y", "ct_eq_val", "t_eq_val", "start_seconds", "end_seconds")
    kinds = dict(events.dtypes)

    def number(c: str) -> Column:
        """Whole numbers need no parsing."""
        return F.col(c).cast("double") if kinds[c] in ("tinyint", "smallint", "int", "bigint") else S.finite(F.col(c))

    cell = lambda c, of, kind: of(c).alias(c) if c in kinds else F.lit(None).cast(kind).alias(c)
    rows = events if max_rows is None else events.where(F.col("src_ord") < max_rows)
    made = [cell(c, lambda c: S.clean_cell(F.col(c)), "string") for c in cells] + [cell(c, number, "double") for c in numbers]
    rows = rows.select("src_ord", "event_type", F.inline(F.array(F.struct(*made))))  # below a generator, each cell is parsed once
    both = F.col("ct_eq_val").isNotNull() & F.col("t_eq_val").isNotNull()
    timed, placed = F.col("end_seconds") > F.col("start_seconds"), F.col("att_pos_x").isNotNull() & F.col("att_pos_y").isNotNull()
    one = F.lit(1).cast("long")
    return rows.select(
        "src_ord", "event_type", *cells, *[F.when(placed, S.grid(F.col(f"att_pos_{c}"))).alias(f"grid_{c}") for c in "xy"], one.alias("n"), "hp_dmg", F.col("hp_dmg").alias("hp_max"),
        F.when(F.col("hp_dmg").isNotNull(), F.col("src_ord")).alias("hp_ord"), "arm_dmg", F.when(timed, F.col("end_seconds") - F.col("start_seconds")).alias("round_secs"), F.when(timed, one).alias("timed"),
        F.when(both, F.col("ct_eq_val")).alias("ct_eq"), F.when(both, F.col("t_eq_val")).alias("t_eq"), F.when(both, one).alias("eq_n"),
    )


def totals(p: DataFrame) -> DataFrame:
    """Prepared rows added up by each set of PARTS, named in `part`: one scan, and a table of as many rows as there are
    combinations, from which all tiers follow. Tiers take it or the prepared rows themselves."""
    keys = list(dict.fromkeys(c for part in PARTS.values() for c in part))
    part = F.when(F.grouping("hitbox") == 0, "weapons").when(F.grouping("grid_x") == 0, "squares").otherwise("rounds")
    added = [f(c).alias(c) for f, names in ((F.sum, SUMS), (F.min, LEAST), (F.max, GREATEST)) for c in names]
    return p.groupingSets([list(c) for c in PARTS.values()], *keys).agg(part.alias("part"), *added)


def _in(p: DataFrame, part: str) -> Column:
    """Which rows to take for a set of columns: all, if they are single events."""
    return F.col("part") == part if "part" in p.columns else F.lit(True)


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))


def _total(name: str, condition: Column | None = None) -> Column:
    return F.coalesce(F.sum(name if condition is None else F.when(condition, F.col(name))), F.lit(0.0))


def histogram(rows: DataFrame, keys: list[str], value: str, top: int | None = None) -> DataFrame:
    """(keys, value, n, place): counts of a value, most frequent first, equal counts in order of first sight. Rows are
    events, or stand for `n` of them."""
    n = F.sum("n") if "n" in rows.columns else F.count(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"), F.min("src_ord").alias("first"))
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")))
    return (ranked if top is None else ranked.where(F.col("place") <= top)).drop("first")


def listed(ranked: DataFrame, keys: list[str], name: str, item: Column) -> DataFrame:
    """One row a key: its items in order, joined by commas. Lists are as long as the histogram is cut."""
    return ranked.groupBy(*keys).agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("s")))), lambda x: x["s"])).alias(name))


def _hits(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.sum("n").alias("count"), _total("hp_dmg").alias("sum_hp"), _total("arm_dmg").alias("sum_arm"),
        F.coalesce(F.greatest(F.max("hp_max"), F.lit(0.0)), F.lit(0.0)).cast("int").alias("max_hp"), _n(F.lower("hitbox") == "head").alias("headshot_count"),
    )


def tier1_rows(p: DataFrame) -> DataFrame:
    return p.where(_in(p, "weapons") & F.col("event_type").isin("damage", "kill") & F.col("map").isNotNull() & F.col("weapon").isNotNull())


def tier1(p: DataFrame) -> DataFrame:
    """Weapons on maps, by event type, with the map's total of that type."""
    return _hits(tier1_rows(p), ["map", "weapon", "event_type"]).withColumn("map_total", F.sum("count").over(Window.partitionBy("map", "event_type")))


def tier2(p: DataFrame) -> DataFrame:
    """Maps, over all event types."""
    events, armed = _in(p, "weapons"), F.col("weapon").isNotNull()
    kind = lambda t: events & (F.col("event_type") == t)
    meta = _in(p, "rounds") & (F.col("event_type") == "round_meta")
    won = lambda side: _n(meta & (F.col("winner_side") == side))
    return p.where(F.col("map").isNotNull() & (events | meta)).groupBy("map").agg(
        _n(events).alias("total"), _n(kind("damage")).alias("damage_count"), _n(kind("kill")).alias("kill_count"), _n(kind("grenade")).alias("grenade_count"), _n(kind("round_meta")).alias("round_meta_count"),
        _total("hp_dmg", kind("damage") & armed).alias("weapon_damage"), _n(kind("kill") & armed).alias("weapon_kills"),
        _n(meta & F.col("winner_side").isNotNull()).alias("winners"), won("CT").alias("ct_wins"), won("T").alias("t_wins"),
        _total("round_secs", meta).alias("sum_round_secs"), F.coalesce(F.sum(F.when(meta, F.col("timed"))), F.lit(0).cast("long")).alias("round_count"),
    )


def tier3_rows(p: DataFrame) -> DataFrame:
    return p.where(_in(p, "squares") & F.col("map").isNotNull() & F.col("grid_x").isNotNull() & F.col("grid_y").isNotNull())


def tier3(p: DataFrame) -> DataFrame:
    """Squares of maps; grenades count as damage."""
    return tier3_rows(p).groupBy("map", "grid_x", "grid_y").agg(_n(F.col("event_type").isin("damage", "grenade")).alias("damage_count"), _n(F.col("event_type") == "kill").alias("kill_count"))


def tier4(p: DataFrame) -> DataFrame:
    """Round types on maps; economies count where both sides' are known."""
    rows = p.where(_in(p, "rounds") & (F.col("event_type") == "round_meta") & F.col("map").isNotNull() & F.col("round_type").isNotNull())
    side = lambda s: _n(F.col("winner_side") == s)
    return rows.groupBy("map", "round_type").agg(
        F.sum("n").alias("count"), _n(F.col("winner_side").isNotNull()).alias("winners"), side("CT").alias("ct_wins"), side("T").alias("t_wins"),
        _total("ct_eq").alias("sum_ct_eq"), _total("t_eq").alias("sum_t_eq"), F.coalesce(F.sum("eq_n"), F.lit(0).cast("long")).alias("eq_count"),
    )


def tier5_rows(p: DataFrame) -> DataFrame:
    return p.where(_in(p, "weapons") & F.col("event_type").isin("damage", "kill") & F.col("weapon").isNotNull())


def tier5(p: DataFrame) -> DataFrame:
    return _hits(tier5_rows(p), ["weapon"])


def _mean(total: str, n: str) -> Column:
    return S.one_decimal(F.when(F.col(n) > 0, F.col(total) / F.col(n)).otherwise(F.lit(0.0)))


def _or(c: str, other: str) -> Column:
    return F.coalesce(F.col(c), F.lit(other))


# The wording of the documents.


def weapon_map_texts(p: DataFrame) -> DataFrame:
    keys = ["map", "weapon", "event_type"]
    rows, base = tier1_rows(p), tier1(p)
    share = lambda v: F.concat(F.col(v), F.lit(" ("), S.percent(F.col("n"), F.col("count")), F.lit("%)"))
    side = F.concat(F.col("att_side"), F.lit(" "), S.percent(F.col("n"), F.col("count")), F.lit("%"))
    few = base.select(*keys, "count")
    boxes = listed(histogram(rows, keys, "hitbox", 4).join(few, keys), keys, "boxes", share("hitbox"))
    sides = listed(histogram(rows, keys, "att_side", 2).join(few, keys), keys, "sides", side)
    full = base.join(boxes, keys, "left").join(sides, keys, "left")
    head = S.percent(F.col("headshot_count"), F.col("count"))
    part = S.percent(F.col("count"), F.col("map_total"))
    damage = F.concat(
        F.lit("Perfil de Arma: "), "weapon", F.lit(" em "), "map", F.lit(" (eventos de dano). Com base em "), S.thousands(F.col("count")), F.lit(" instâncias de dano registradas: Dano HP médio por acerto: "), _mean("sum_hp", "count"),
        F.lit(" | Máximo: "), F.col("max_hp").cast("string"), F.lit(". Dano de armadura médio: "), _mean("sum_arm", "count"), F.lit(". Taxa de headshot: "), head, F.lit("% dos acertos. Hitboxes mais atingidas: "), _or("boxes", "N/A"),
        F.lit(". Distribuição por lado atacante: "), _or("sides", "N/A"), F.lit(". Esta arma representa "), part, F.lit("% dos eventos de dano em "), "map", F.lit("."),
    )
    kill = F.concat(
        F.lit("Perfil de Mortes: "), "weapon", F.lit(" em "), "map", F.lit(" (eventos de kill). Total de mortes registradas: "), S.thousands(F.col("count")), F.lit(". Taxa de headshot fatal: "), head, F.lit("%. Hitboxes fatais mais comuns: "), _or("boxes", "N/A"),
        F.lit(". Distribuição por lado atacante: "), _or("sides", "N/A"), F.lit(". Esta arma representa "), part, F.lit("% dos eventos de kill em "), "map", F.lit("."),
    )
    return full.select(*keys, "count", F.when(F.col("event_type") == "damage", damage).otherwise(kill).alias("text"))


def map_texts(p: DataFrame) -> DataFrame:
    base = tier2(p)
    events = p.where(_in(p, "weapons") & F.col("map").isNotNull())
    dmg = events.where("event_type = 'damage' AND weapon IS NOT NULL AND hp_dmg IS NOT NULL").groupBy("map", "weapon").agg(F.sum("hp_dmg").alias("v"), F.min("hp_ord").alias("first"))
    dmg = dmg.withColumn("place", F.row_number().over(Window.partitionBy("map").orderBy(F.col("v").desc(), "first"))).where("place <= 5").join(base.select("map", "weapon_damage"), "map")
    top_damage = listed(dmg, ["map"], "top_damage", F.concat("weapon", F.lit(" ("), S.percent(F.col("v"), F.col("weapon_damage")), F.lit("%)")))
    kills = histogram(events.where("event_type = 'kill'"), ["map"], "weapon", 5).join(base.select("map", "weapon_kills"), "map")
    top_kills = listed(kills, ["map"], "top_kills", F.concat("weapon", F.lit(" ("), S.percent(F.col("n"), F.col("weapon_kills")), F.lit("%)")))
    n = lambda c: S.thousands(F.col(c))
    text = F.concat(
        F.lit("Visão Geral do Mapa: "), "map", F.lit(". Total de eventos registrados: "), n("total"), F.lit(" (dano: "), n("damage_count"), F.lit(", kills: "), n("kill_count"), F.lit(", granadas: "), n("grenade_count"), F.lit(", rounds: "), n("round_meta_count"),
        F.lit("). Top 5 armas por dano total causado: "), _or("top_damage", "N/A"), F.lit(". Top 5 armas por número de kills: "), _or("top_kills", "N/A"), F.lit(". Taxa de vitória: CT "), S.percent(F.col("ct_wins"), F.col("winners")), F.lit("%, T "), S.percent(F.col("t_wins"), F.col("winners")),
        F.lit("%. Duração média de round: "), _mean("sum_round_secs", "round_count"), F.lit("s. Total de rounds registrados: "), n("round_meta_count"), F.lit("."),
    )
    return base.join(top_damage, "map", "left").join(top_kills, "map", "left").select("map", "total", text.alias("text"))


def hotspot_texts(p: DataFrame) -> DataFrame:
    keys = ["map", "grid_x", "grid_y"]
    rows, base = tier3_rows(p), tier3(p)
    fights = rows.where(F.col("event_type").isin("damage", "kill"))

    def shares(value: str, top: int | None, pattern: tuple[str, str], name: str) -> DataFrame:
        h = histogram(fights, keys, value).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
        return listed(h if top is None else h.where(F.col("place") <= top), keys, name, F.concat(F.col(value), F.lit(pattern[0]), S.percent(F.col("n"), F.col("all")), F.lit(pattern[1])))

    nades = listed(histogram(rows.where("event_type = 'grenade'"), keys, "nade", 3), keys, "nades", F.concat("nade", F.lit(": "), F.col("n").cast("string")))
    full = base.join(shares("weapon", 3, (" (", "%)"), "weapons"), keys, "left").join(shares("att_side", None, (" ", "%"), "sides"), keys, "left").join(nades, keys, "left")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("Zona de Combate: "), "map", F.lit(", setor x:["), s(F.col("grid_x")), F.lit(","), s(F.col("grid_x") + S.GRID), F.lit("] y:["), s(F.col("grid_y")), F.lit(","), s(F.col("grid_y") + S.GRID), F.lit("]. Eventos de dano: "), S.thousands(F.col("damage_count")),
        F.lit(". Eventos de kill: "), S.thousands(F.col("kill_count")), F.lit(". Total de ações registradas: "), S.thousands(F.col("damage_count") + F.col("kill_count")), F.lit(". Armas mais usadas nesta zona: "), _or("weapons", "N/A"), F.lit(". Distribuição por lado atacante: "), _or("sides", "N/A"),
        F.lit(". Granadas usadas: "), _or("nades", "sem granadas"), F.lit("."),
    )
    return full.select(*keys, text.alias("text"))


def round_type_texts(p: DataFrame) -> DataFrame:
    mean = lambda c: S.thousands(F.when(F.col("eq_count") > 0, F.bround(F.col(c) / F.col("eq_count"), 0)).otherwise(F.lit(0.0)))
    text = F.concat(
        F.lit("Perfil de Round: tipo '"), "round_type", F.lit("' em "), "map", F.lit(". Total de rounds deste tipo: "), S.thousands(F.col("count")), F.lit(". Taxa de vitória: CT "), S.percent(F.col("ct_wins"), F.col("winners")), F.lit("%, T "), S.percent(F.col("t_wins"), F.col("winners")),
        F.lit("%. Equipamento médio: CT R$"), mean("sum_ct_eq"), F.lit(", T R$"), mean("sum_t_eq"), F.lit("."),
    )
    return tier4(p).select("map", "round_type", "count", text.alias("text"))


def weapon_texts(p: DataFrame) -> DataFrame:
    maps = listed(histogram(tier5_rows(p), ["weapon"], "map", 3), ["weapon"], "maps", F.concat("map", F.lit(" ("), S.thousands(F.col("n")), F.lit(")")))
    text = F.concat(
        F.lit("Perfil Global de Arma: "), "weapon", F.lit(" (todos os mapas, eventos de dano). Total de acertos registrados: "), S.thousands(F.col("count")), F.lit(". Dano HP médio por acerto: "), _mean("sum_hp", "count"), F.lit(" | Máximo: "), F.col("max_hp").cast("string"),
        F.lit(". Dano de armadura médio: "), _mean("sum_arm", "count"), F.lit(". Taxa de headshot: "), S.percent(F.col("headshot_count"), F.col("count")), F.lit("%. Mapas com mais eventos: "), _or("maps", "N/A"), F.lit("."),
    )
    return tier5(p).join(maps, "weapon", "left").select("weapon", "count", text.alias("text"))


def documents(events: DataFrame, run_id: str, prefix: str = "matches", source_run_id: str = "gold-run", max_rows: int | None = None) -> DataFrame:
    """All tiers as doc_id, doc_index, document_tier, text, metadata. Numbers run over tiers and their sorted keys; the
    rows numbered are aggregates, so that one sort is small whatever the number of events. The events are read once, when
    this is called: their totals are written to the session's shared folder, and the documents are made from there."""
    p = written(totals(prepared(events, max_rows)), "document-totals")
    weapon, maps, zones, kinds, global_ = weapon_map_texts(p), map_texts(p), hotspot_texts(p), round_type_texts(p), weapon_texts(p)
    s = lambda c: F.col(c).cast("string")
    null = F.lit(None).cast("string")

    def tier(k: int, df: DataFrame, event_type: Column, keys: list[Column], meta: dict[str, Column]) -> DataFrame:
        fields = {"document_tier": F.lit(TIERS[k - 1]), "event_type": event_type, **meta}
        sort = [*keys, *[null] * (3 - len(keys))]
        gx, gy = (F.col("grid_x"), F.col("grid_y")) if k == 3 else (F.lit(None).cast("int"),) * 2
        return df.select(F.lit(k).alias("tier"), *[c.alias(f"k{i}") for i, c in enumerate(sort)], gx.alias("gx"), gy.alias("gy"), "text", F.create_map(*[x for a, b in fields.items() for x in (F.lit(a), b)]).alias("meta"))

    parts = [
        tier(1, weapon, F.col("event_type"), [F.col("map"), F.col("weapon"), F.col("event_type")], {"map": F.col("map"), "weapon": F.col("weapon"), "count": s("count")}),
        tier(2, maps, F.lit("overview"), [F.col("map")], {"map": F.col("map")}),
        tier(3, zones, F.lit("spatial"), [F.col("map")], {"map": F.col("map"), "grid_x": s("grid_x"), "grid_y": s("grid_y")}),
        tier(4, kinds, F.lit("round_meta"), [F.col("map"), F.col("round_type")], {"map": F.col("map"), "round_type": F.col("round_type"), "count": s("count")}),
        tier(5, global_, F.lit("damage"), [F.col("weapon")], {"weapon": F.col("weapon"), "count": s("count")}),
    ]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    rows = rows.withColumn("doc_index", F.row_number().over(Window.orderBy("tier", "k0", "gx", "gy", "k1", "k2")).cast("long")).withColumn("doc_id", S.doc_id(run_id, F.col("doc_index")))
    base = F.create_map(F.lit("doc_id"), F.col("doc_id"), *[x for a, b in {"document_run_id": run_id, "dataset_prefix": prefix, "source_run_id": source_run_id}.items() for x in (F.lit(a), F.lit(b))])
    return rows.select("doc_id", "doc_index", F.col("meta")["document_tier"].alias("document_tier"), "text", F.map_concat(base, "meta").alias("metadata"))


def part_manifest(docs: DataFrame, rows: int = PART_ROWS) -> DataFrame:
    """part, rows, first_doc_id, last_doc_id of files of a fixed number of documents."""
    parts = docs.withColumn("part", (F.floor((F.col("doc_index") - 1) / rows) + 1).cast("int"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min_by("doc_id", "doc_index").alias("first_doc_id"), F.max_by("doc_id", "doc_index").alias("last_doc_id"))


def write_parts(docs: DataFrame, folder: str, rows: int = PART_ROWS) -> DataFrame:
    """JSON lines, a folder `part=N` for each part, in document order; returns the manifest."""
    parts = docs.withColumn("part", (F.floor((F.col("doc_index") - 1) / rows) + 1).cast("int"))
    parts.repartition("part").sortWithinPartitions("part", "doc_index").select("part", "doc_id", "text", "metadata").write.mode("overwrite").partitionBy("part").json(folder)
    return part_manifest(docs, rows)


def tier_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("document_tier").agg(F.count(F.lit(1)).alias("documents"))


def preview(docs: DataFrame, n: int) -> DataFrame:
    """The first documents over all parts, in their order."""
    return docs.orderBy("doc_index").limit(n)
