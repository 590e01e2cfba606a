"""Set-at-a-time lookups: atoms, diaries, links, users, names, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators.skew import top_n
from recollect.session import broadcast_if_small, cut_lineage


# ------------------------------------------------------------- atoms and diaries

def atoms_of_users(atoms: DataFrame, users: DataFrame, status: str | None = "active") -> DataFrame:
    rows = atoms.filter(F.col("status") == status) if status else atoms
    return rows.join(users.select("user_id").distinct(), "user_id", "left_semi").orderBy(F.desc("created_at"), "atom_id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def latest_per_date(diaries: DataFrame) -> DataFrame:
    """The latest diary of each date."""
    return diaries.groupBy("date").agg(F.max("diary_id").alias("diary_id"), F.max_by("content", "diary_id").alias("content"))


def in_month(diaries: DataFrame, year: int, month: int | None = None) -> DataFrame:
    rows = diaries.filter(F.year("date") == year)
    return rows.filter(F.month("date") == month) if month else rows


def archived(diaries: DataFrame) -> DataFrame:
    return diaries.filter("archived").orderBy(F.desc("date"), F.desc("diary_id"))


def atoms_by_diary(atoms: DataFrame, links: DataFrame, status: str = "active") -> DataFrame:
    """Atoms with the diaries they are linked to and the link's importance."""
    a = atoms.filter(F.col("status") == status)
    l = links.select("atom_id", "diary_id", F.col("importance").alias("link_importance"))  # noqa: E741
    return a.join(l, "atom_id")


def diaries_by_atom(links: DataFrame, atoms: DataFrame) -> DataFrame:
    return links.join(atoms.select("atom_id").distinct(), "atom_id", "left_semi").orderBy(
        "atom_id", F.desc("importance"), "diary_id")


def diary_with_atoms(diaries: DataFrame, atoms: DataFrame, links: DataFrame) -> DataFrame:
    """Each diary row with its active atoms beside it (one row per atom, or one with nulls)."""
    a = atoms_by_diary(atoms, links).select("diary_id", "atom_id", F.col("content").alias("atom_content"), "link_importance")
    return diaries.join(a, "diary_id", "left")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def missing_diary_links(links: DataFrame, diaries: DataFrame) -> DataFrame:
    return links.join(diaries.select("diary_id"), "diary_id", "left_anti")


def dates_without_diary(atoms: DataFrame, diaries: DataFrame) -> DataFrame:
    d = diaries.select(F.col("date").alias("diary_date"))
    return atoms.select("diary_date").distinct().join(d, "diary_date", "left_anti")


def recent_diaries_of_users(atoms: DataFrame, links: DataFrame, diaries: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` distinct diaries of each user through atoms and links."""
    a = atoms.filter(F.col("status") == "active").select("atom_id", "user_id")
    pairs = a.join(links.select("atom_id", "diary_id"), "atom_id").select("user_id", "diary_id").distinct()
    rows = pairs.join(diaries.select("diary_id", "date", "content"), "diary_id")
    return top_n(rows, ["user_id"], [F.desc("date"), F.desc("diary_id")], n)


# ------------------------------------------------------------- names and identities

def name_index(users: DataFrame) -> DataFrame:
    """``(name, uid)``: the smallest uid that carries the name."""
    return users.select("uid", F.explode("names").alias("name")).groupBy("name").agg(F.min("uid").alias("uid"))


def uid_of_names(requests: DataFrame, users: DataFrame, name: str = "name") -> DataFrame:
    return requests.join(name_index(users).withColumnRenamed("name", name), name, "left")


def platform_index(identities: DataFrame) -> DataFrame:
    """``(platform, platform_id, uid)``."""
    ids = identities.select("uid", F.explode("platform_ids").alias("platform", "ids"))
    return ids.select("uid", "platform", F.explode("ids").alias("platform_id")).groupBy("platform", "platform_id").agg(
        F.min("uid").alias("uid"))


def uid_of_platform_ids(requests: DataFrame, identities: DataFrame) -> DataFrame:
    return requests.join(platform_index(identities), ["platform", "platform_id"], "left")


def resolve_ids(requests: DataFrame, users: DataFrame, identities: DataFrame, platform: str = "qq") -> DataFrame:
    """Raw id to uid: platform id, then uid, then any name, else the raw id itself."""
    plat = platform_index(identities).filter(F.col("platform") == platform).select(
        F.col("platform_id").alias("raw"), F.col("uid").alias("_p"))
    own = users.select(F.col("uid").alias("raw"), F.col("uid").alias("_u")).distinct()
    named = name_index(users).select(F.col("name").alias("raw"), F.col("uid").alias("_n"))
    return requests.join(plat, "raw", "left").join(own, "raw", "left").join(named, "raw", "left").withColumn(
        "uid", F.coalesce("_p", "_u", "_n", "raw")).drop("_p", "_u", "_n")


def aliases(users: DataFrame, identities: DataFrame) -> DataFrame:
    """``(uid, alias)``: the uid itself, its platform ids and its names."""
    ids = identities.select("uid", F.explode("platform_ids").alias("platform", "ids"))
    return (
        users.select("uid", F.col("uid").alias("alias"))
        .unionByName(ids.select("uid", F.explode("ids").alias("alias")))
        .unionByName(users.select("uid", F.explode("names").alias("alias")))
        .distinct()
    )


def related_ids(requests: DataFrame, users: DataFrame, identities: DataFrame) -> DataFrame:
    """Every id of the person owning the asked id; an unknown id stands alone."""
    al = cut_lineage(aliases(users, identities).filter("uid IS NOT NULL AND alias IS NOT NULL"))
    # pairs repeat only where the asked id and the other one share several owners: those alone are compared
    shared = cut_lineage(al.groupBy("alias").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("alias", F.lit(True).alias("_shared")))
    al = cut_lineage(al.join(broadcast_if_small(shared), "alias", "left"))
    known = requests.select("id").distinct().join(al.select(F.col("alias").alias("id"), "uid", F.col("_shared").alias("_several")), "id", "left")
    out = known.join(al, "uid", "left").select("id", F.coalesce("alias", "id").alias("related_id"), (F.col("_several") & F.col("_shared")).alias("_both"))
    return out.filter("_both IS NULL").drop("_both").unionByName(out.filter("_both").drop("_both").distinct())


def display_name(uid: Column, names: Column) -> Column:
    tail = F.when(F.length(uid) >= 4, F.right(uid, F.lit(4))).otherwise(F.lit(""))
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.concat(F.lit("用户"), tail))


def display_names(requests: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select("uid", "names")
    return requests.join(u, "uid", "left").withColumn("display_name", display_name(F.col("uid"), F.col("names"))).drop("names")


def users_with_persona(users: DataFrame, personas: DataFrame) -> DataFrame:
    """All users with their persona where there is one, most recently rebuilt first."""
    p = personas.select("uid", "summary", "tier", "last_full_update")
    return users.join(p, "uid", "left").select(
        "uid", F.coalesce(F.try_element_at("names", F.lit(1)), "uid").alias("name"),
        F.coalesce("tier", F.lit("new")).alias("tier"), F.substring(F.coalesce("summary", F.lit("")), 1, 100).alias("summary"),
        "last_full_update").orderBy(F.desc_nulls_last("last_full_update"), "uid")


def persona_vectors(users: DataFrame, personas: DataFrame) -> DataFrame:
    p = personas.filter(F.col("persona_embedding").isNotNull()).select("uid", F.col("persona_embedding").alias("embedding"))
    return users.select("uid", "names").join(p, "uid")


def persona_of_names(requests: DataFrame, users: DataFrame, personas: DataFrame) -> DataFrame:
    """Display name to uid to persona."""
    return uid_of_names(requests, users).join(personas, "uid", "left")
