"""One surviving record of every duplicate group, field by field, by iterative truth discovery."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

KEY = ["graph_no", "graph_version", "graph_node_no"]

#: Wordings that stand in for "not known", lower case, without blanks and punctuation.
STAND_INS = """
na nan none null nil nul unknown unkown undefined undef unspecified notspecified notknown notavailable notapplicable
notprovided notset notgiven notstated nodata noinfo noinformation novalue nodescription missing empty blank tbd tba tbc
tbf todo pending placeholder dummy xxx xx fixme tobefilledin tobefilled tobedetermined tobedefined tobeconfirmed
tobeannounced tobeadded tobecompleted tobedone tofollow comingsoon fillin fillmein fillinlater seelater dontknow
idk nodescriptionavailable nodescriptionyet descriptionpending unavailable
ka keineangabe keineangaben keinedaten keine keiner unbekannt nichtbekannt nichtverfügbar nichtangegeben nichtvorhanden
entfällt folgt folgtnoch nochoffen offen fehlt ohneangabe oa nv nb ausstehend nochzuergänzen zuergänzen wirdnachgereicht
nochauszufüllen auszufüllen leer unklar nichtzutreffend
sd si nd sindatos sindato sininformación sininformacion sindescripción sindescripcion desconocido desconocida nodisponible
noaplica noconsta nosesabe nodefinido ninguno ninguna pendiente porcompletar pordefinir porrellenar porconfirmar
sinespecificar noespecificado vacío vacio
待补充 待补 待定 待填 待填写 待完善 待确认 未知 未填 未填写 未提供 未定 未定义 不详 不明 无 暂无 暂无描述 暂无数据 空 空白 缺失 暂缺 没有 无数据 不适用 尚未填写
inconnu inconnue nonrenseigné nonrenseigne nc aucun aucune néant àcompléter acompleter àdéfinir sansobjet so
sconosciuto dacompletare nessuno nondisponibile desconhecido semdados nenhum nãoinformado adefinir onbekend nvt geen
neznámý nieznany brak неизвестно нетданных нд нет なし 未記入 未設定 該当なし 없음 미정
""".split()

#: What may mark the place where a description was cut.
CUT_MARK = r"(?i)\s*(\[[^\]]{0,20}\]|\((?:\.{2,}|…|cut|truncated|more|continued)\)|…|\.{2,}|&hellip;|‥)\s*$"
#: Descriptions are compared within a group by this many leading characters first, which spreads a hot group.
HEAD = 12
#: The class of statements without a time; lags of more than 2**60 seconds do not occur.
OLDEST = 62
#: Greatest trust in a source.
SURE = 1 - 1e-6


def is_stand_in(value: Column) -> Column:
    """True for null, blank and punctuation-only values and for wordings of "not known"."""
    # letters, digits and marks alone; what else there is says nothing
    bare = F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}\p{M}]+", ""))
    return value.isNull() | (bare == "") | bare.isin(STAND_INS)


def _cut_descriptions(rows: DataFrame) -> DataFrame:
    """(KEY, description) that are, but for a mark, the beginning of another description of their group."""
    folded = F.lower(F.regexp_replace(F.trim(F.regexp_replace("description", CUT_MARK, "")), r"(?U)\s+", " "))
    texts = (
        rows.filter("description is not null").select(*KEY, "description").distinct()
        .withColumns({"marked": F.col("description").rlike(CUT_MARK), "p": folded}).filter("p <> ''")
    )
    stems = texts.groupBy(*KEY, "p").agg(F.bool_or(~F.col("marked")).alias("whole"))
    # A beginning sorts directly before the texts it begins, so its next neighbour alone decides.
    order = Window.partitionBy(*KEY, "head").orderBy("p")
    long = stems.withColumn("head", F.left("p", F.lit(HEAD))).withColumn("after", F.lead("p").over(order))
    begun = long.filter(F.col("after").startswith(F.col("p"))).select(*KEY, "p")
    # Beginnings shorter than the head are looked up among the heads' own beginnings.
    short = stems.filter(F.length("p") < HEAD).select(*KEY, "p")
    heads = stems.select(*KEY, F.left("p", F.lit(HEAD)).alias("head")).distinct()
    begins = heads.select(*KEY, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("head") - 1, F.lit(1))), lambda n: F.left(F.col("head"), n))).alias("p"), "head").filter("p <> head").select(*KEY, "p").distinct()
    begun = begun.unionByName(short.join(begins, _same(short, begins, [*KEY, "p"]), "left_semi")).distinct().withColumn("begun", F.lit(True))
    # A marked text that says the same as an unmarked one is cut, too.
    marks = stems.filter("whole").select(*KEY, "p").withColumn("twin", F.lit(True))
    out = texts.alias("t")
    for extra in (begun, marks):
        renamed = extra.select(*[F.col(c).alias(f"_{c}") for c in [*KEY, "p"]], extra.columns[-1])
        on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY] + [F.col("p") == F.col("_p")]
        out = out.join(renamed, on, "left").drop(*[f"_{c}" for c in [*KEY, "p"]])
    return out.filter(F.coalesce("begun", F.lit(False)) | (F.col("marked") & F.coalesce("twin", F.lit(False)))).select(*KEY, "description")


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in columns]


def field_claims(rows: DataFrame) -> DataFrame:
    """(KEY, field, value, update_time, id): every usable value every row states."""
    cut = _cut_descriptions(rows).select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("description").alias("_d"))
    base = rows.select(*KEY, "id", "update_time", "name", "description", "properties", "ref")
    says = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    bag = F.expr("try_cast(try_parse_json(properties) as map<string,variant>)")
    text = F.col("p.value").try_cast("string") if hasattr(Column, "try_cast") else F.expr("try_cast(p.value as string)")
    plain = base.select(
        *KEY, "id", "update_time",
        F.explode(F.array(says("name", F.col("name")), says("description", F.col("description")))).alias("x"),
    ).select(*KEY, "id", "update_time", "x.field", "x.value").filter(~is_stand_in(F.col("value")))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY] + [F.col("value") == F.col("_d"), F.col("field") == "description"]
    plain = plain.join(cut, on, "left_anti")
    props = (
        base.filter("properties is not null").select(*KEY, "id", "update_time", F.explode(F.map_entries(bag)).alias("p"))
        .filter(F.expr("not is_variant_null(p.value)")).filter(~is_stand_in(text))
        .select(*KEY, "id", "update_time", F.concat(F.lit("properties."), "p.key").alias("field"), F.to_json("p.value").alias("value"))
    )
    refs = (
        base.filter("ref is not null").select(*KEY, "id", "update_time", F.explode(F.map_entries("ref")).alias("p"))
        .filter(F.exists("p.value", lambda t: t.isNotNull() & t.rlike(r"(?U)\S")))
        .select(*KEY, "id", "update_time", F.concat(F.lit("ref."), "p.key").alias("field"), F.to_json("p.value").alias("value"))
    )
    return plain.unionByName(props).unionByName(refs)


def age_class(latest: Column, time: Column) -> Column:
    """0 for a statement as late as the latest of its field, then one class a doubling of the lag in seconds; the last
    class is that of rows without a time, unless no row of the field has one."""
    seconds = lambda t: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t.cast("timestamp_ntz"))
    lag = seconds(latest) - seconds(time)
    old = F.least(F.lit(OLDEST - 1), F.floor(F.log2(F.greatest(lag, F.lit(1)).cast("double"))).cast("int") + 1)
    return F.when(latest.eqNullSafe(time), 0).when(time.isNull(), OLDEST).otherwise(old)


def discover_truth(statements: DataFrame, scratch: Scratch, *, tolerance: float = 1e-4, limit: int = 60) -> tuple[DataFrame, dict[int, float]]:
    """((slot, vote, support), trust by source) of statements (slot, vote, source, n rows), source a small number.

    Sources are stable across all fields; n rows of one source count 1 + ln n times. Of every slot the value with the most support is taken for true; a source's trust becomes the share of its statements that are
    true, and its weight -ln(1 - trust), until no trust moves by more than ``tolerance``. Trust that swings is damped;
    if it has not come to rest after ``limit`` rounds, that is an error. The driver holds one number a source.
    """
    found = {r[0] for r in statements.select("source").distinct().collect()}
    # before anything is known, what is said last is believed
    trust = {c: SURE if c == 0 else 0.5 for c in found}
    if not found:
        return statements.select("slot", "vote", F.lit(0.0).alias("support")), trust

    def votes(trust: dict[int, float]) -> DataFrame:
        weight = F.create_map(*[x for c, t in sorted(trust.items()) for x in (F.lit(c), F.lit(-math.log1p(-t)))])
        return statements.groupBy("slot", "vote").agg(F.round(F.sum(weight[F.col("source")] * (1 + F.ln("n"))), 9).alias("support"))

    for number in range(limit):
        best = votes(trust).groupBy("slot").agg(F.max(F.struct("support", "vote")).alias("x")).select("slot", F.col("x.vote").alias("true"))
        rows = statements.join(best, "slot").groupBy("source").agg(F.sum(F.when(F.col("vote") == F.col("true"), F.col("n")).otherwise(0)) / F.sum("n")).collect()
        told = {c: min(t, SURE) for c, t in rows}
        if number >= 5:
            told = {c: (t + trust[c]) / 2 for c, t in told.items()}
        moved = max(abs(t - trust[c]) for c, t in told.items())
        trust = told
        if moved <= tolerance:
            return scratch.write(votes(trust)), trust
    raise RuntimeError(f"trust has not come to rest after {limit} rounds: {trust}")


def surviving_values(nodes: DataFrame, *, check: bool = True) -> DataFrame:
    """(KEY, field, id) of the surviving value of every field of every key with two or more rows.

    The surviving value is the one truth discovery finds the best supported, where the sources are the ages of
    statements: how long before the field's latest statement a row was written. It learns from all fields on which rows
    differ how much a statement of an age is worth. ``check`` then makes sure of the definition that the latest
    update_time wins (null is oldest): where the value found is not the latest, the best supported of the latest takes its
    place. Equal support goes to the smaller id. ``id`` is the smallest id of the group's rows that hold exactly this
    value. Null key columns are keys like any other; rows repeated in full count as rows; a field without a usable value
    gives no row; columns not named are ignored; an empty table gives an empty result. Claims are only aggregated, never
    gathered; the descriptions of one key that begin with the same letters are sorted in one task.
    """
    scratch = Scratch(nodes.sparkSession, "survivors")
    several = nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in KEY])
    rows = nodes.select(*KEY, "id", "name", "description", "properties", "ref", "update_time")
    rows = scratch.write(rows.join(several, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY], "left_semi"))
    claims = scratch.write(field_claims(rows).withColumns({"slot": F.xxhash64(*KEY, "field"), "vote": F.xxhash64("value", F.lit(1))}))
    values = scratch.write(claims.groupBy(*KEY, "field", "slot", "vote", "value").agg(F.max("update_time").alias("last"), F.min("id").alias("id")).drop("value"))
    scratch.drop(rows)
    slots = scratch.write(values.groupBy("slot").agg(F.max("last").alias("latest"), F.count(F.lit(1)).alias("values")))
    # fields on which all rows agree need no discovery
    open_ = slots.filter("values > 1").select("slot", "latest")
    statements = scratch.write(claims.select("slot", "vote", "update_time").join(open_, "slot").select("slot", "vote", age_class(F.col("latest"), F.col("update_time")).alias("source")).groupBy("slot", "vote", "source").agg(F.count(F.lit(1)).alias("n")))
    scratch.drop(claims)
    support, _ = discover_truth(statements, scratch)
    scored = values.join(slots.select("slot", "latest"), "slot").join(support, ["slot", "vote"], "left")
    order = [F.col("last").eqNullSafe(F.col("latest")).alias("late")] if check else []
    best = scored.groupBy(*KEY, "field").agg(F.max(F.struct(*order, F.coalesce("support", F.lit(0.0)).alias("support"), (-F.col("id")).alias("neg"))).alias("x"))
    return best.select(*KEY, "field", (-F.col("x.neg")).alias("id"))
