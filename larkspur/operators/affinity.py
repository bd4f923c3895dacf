"""Market baskets: pairs, rules and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scalars import is_type
from larkspur.plans.dealing import ROWS, dealt
from larkspur.plans.staging import discard, staged
from larkspur.sources.schema import PURCHASE


def baskets(df: DataFrame) -> DataFrame:
    """Purchase rows: session and product."""
    return df.filter(is_type(PURCHASE)).select("user_session", "product_id")


#: Products of a session that meet each other in one task; a session with more is cut into blocks of about so many.
BLOCK = 512
#: Pairs that a task takes, as ROWS of rows.
PAIRS = 500_000


def basket_lines(rows: DataFrame, tasks: int = 0) -> DataFrame:
    """user_session, product_id, c: a session's products with their multiplicity.

    With a number of tasks the rows are dealt to so many first: as few rows repeat, counting before that saves nothing.
    """
    rows = dealt(rows.filter("user_session IS NOT NULL AND product_id IS NOT NULL"), tasks, "user_session", "product_id")
    return rows.groupBy("user_session", "product_id").agg(F.count("*").alias("c"))


def shared_lines(lines: DataFrame, tasks: int = 0) -> DataFrame:
    """The lines of sessions with several products, with how many these are and the most frequent one's multiplicity."""
    own = Window.partitionBy("user_session")
    return dealt(lines, tasks, "user_session").withColumns({"most": F.max("c").over(own), "products": F.count("*").over(own)}).filter("products > 1")


def supported_lines(lines: DataFrame, min_support: int, distinct: bool, tasks: int = 0) -> DataFrame:
    """Of shared_lines() those whose product may be in a pair of that support.

    By sessions, a pair has at most as many as either product. By row pairs, a product meets another in a session at most
    c times the most frequent product's c, so the sum of these bounds all its pairs.

    With a number of tasks both sides are dealt to so many, the lines of a product with more than ROWS in parts of about
    so many. There are at most as many such products as the lines make tasks, so they are broadcast.
    """
    reach = F.count("*") if distinct else F.sum(F.col("c") * F.col("most"))
    able = lines.groupBy("product_id").agg(reach.alias("reach"), F.floor(1 + F.count("*") / ROWS).alias("parts")).filter(F.col("reach") >= min_support)
    large = F.broadcast(able.filter("parts > 1").select("product_id", "parts"))
    cut = lines.join(large, "product_id", "left").withColumn("part", F.pmod(F.xxhash64("user_session"), F.coalesce("parts", F.lit(1)))).drop("parts")
    able = able.select("product_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt(cut, tasks, "product_id", "part").join(dealt(able, tasks, "product_id", "part"), ["product_id", "part"], "left_semi").drop("part")


def pair_cells(lines: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a session's pairs, each dealt to cells (user_session, p, q) in which all of them meet.

    A session of n products has ceil(n / block) blocks by hash of the product, and a cell for every two of them and every
    one: a triangle of fragments. A session of few products is one cell.
    """
    cut = lines.withColumn("blocks", F.ceil(F.col("products") / block).cast("int"))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("product_id"), F.col("blocks")).cast("int"))
    a = cut.select("user_session", F.col("own").alias("p"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("q"), F.col("product_id").alias("product_a"), F.col("c").alias("c_a"))
    b = cut.select("user_session", F.explode(F.sequence(F.lit(0), "own")).alias("p"), F.col("own").alias("q"), F.col("product_id").alias("product_b"), F.col("c").alias("c_b"))
    return a, b


def product_pairs(rows: DataFrame, min_support: int = 5, directed: bool = True, distinct: bool = False, block: int = BLOCK) -> DataFrame:
    """Products bought in one session, by row pairs or by distinct sessions.

    Each session keeps one row a product with its multiplicity, so a pair of rows costs one product of counts. Products
    that can't reach min_support leave before the join. A session with many products is spread over as many tasks as it
    has cells (pair_cells), each with block * block pairs at most. Pairs are joined and counted one way; directed ones
    are turned around afterwards.

    The rows are written once, unless staged() did, and so are the lines, before and after that: they tell how many rows and pairs there are,
    and so how many tasks it takes for each to hold a bounded part of them, whatever the session's settings. Pairs are
    counted before they are dealt only where the products are so few that most pairs repeat.
    """
    held = rows if hasattr(rows, "staged_at") else staged(rows, "baskets")
    tasks = 1 + held.count() // ROWS
    shared = staged(shared_lines(basket_lines(held, tasks), tasks), "lines")
    if held is not rows:
        discard(held)
    size = shared.agg(F.count("*").alias("lines"), F.coalesce(F.sum((F.col("products") - 1) / 2), F.lit(0.0)).alias("pairs"), F.approx_count_distinct("product_id").alias("products")).first()
    able = staged(supported_lines(shared, min_support, distinct, 1 + size.lines // ROWS), "able")
    discard(shared)
    tasks = 1 + max(size.lines // ROWS, int(size.pairs) // PAIRS)
    a, b = (dealt(side, tasks, "user_session", "p", "q") for side in pair_cells(able, block))
    met = a.join(b, ["user_session", "p", "q"]).filter("p < q OR product_a < product_b")
    met = met.select(F.least("product_a", "product_b").alias("product_a"), F.greatest("product_a", "product_b").alias("product_b"), "c_a", "c_b")
    met = met if 2 * size.products**2 < size.pairs else dealt(met, tasks, "product_a", "product_b")
    n = F.count("*") if distinct else F.sum(F.col("c_a") * F.col("c_b"))
    pairs = met.groupBy("product_a", "product_b").agg(n.alias("pair_count")).filter(F.col("pair_count") >= min_support)
    if not directed:
        return pairs
    ways = F.array(F.struct("product_a", "product_b"), F.struct(F.col("product_b").alias("product_a"), F.col("product_a").alias("product_b")))
    return pairs.select(F.explode(ways).alias("way"), "pair_count").select("way.product_a", "way.product_b", "pair_count")


def product_support(rows: DataFrame, distinct: bool = False) -> DataFrame:
    return rows.groupBy("product_id").agg((F.count_distinct("user_session") if distinct else F.count("*")).alias("support"))


def total_sessions(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("user_session").alias("total"))


def total_purchase_sessions(df: DataFrame) -> DataFrame:
    return total_sessions(df.filter(is_type(PURCHASE)))


def affinity_rules(df: DataFrame, min_support: int = 5, variant: str = "f", min_lift: float | None = 1.2) -> DataFrame:
    """confidence = n(AB) / n(A), lift = n(AB) N / (n(A) n(B)), in doubles. F: row pairs, both ways. C: sessions, one way."""
    distinct, rows = variant == "c", staged(baskets(df), "baskets")
    # a product's sessions are its lines; those of products without a session are in no pair
    support = product_support(basket_lines(rows, 1 + rows.count() // ROWS) if distinct else rows)
    pairs = product_pairs(rows, min_support, directed=not distinct, distinct=distinct)
    for x in "ab":
        pairs = pairs.join(support.select(F.col("product_id").alias(f"product_{x}"), F.col("support").cast("double").alias(f"n_{x}")), f"product_{x}")
    lift = F.col("pair_count").cast("double") * F.col("total") / (F.col("n_a") * F.col("n_b"))
    rules = pairs.crossJoin(F.broadcast(total_sessions(rows))).select("product_a", "product_b", "pair_count", (F.col("pair_count") / F.col("n_a")).alias("confidence"), lift.alias("lift"))
    return rules if min_lift is None else rules.filter(F.col("lift") > min_lift)


def _named(products: DataFrame, x: str) -> DataFrame:
    return products.select(F.col("product_id").alias(f"product_{x}"), F.col("brand").alias(f"brand_{x}"), F.col("category_code").alias(f"category_{x}"))


def top_pairs_preview(rules: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent rules with brands and categories: the names join n rows alone."""
    top = rules.orderBy(F.desc("pair_count"), "product_a", "product_b").limit(n)
    return top.join(_named(products, "a"), "product_a").join(_named(products, "b"), "product_b")


def brands_with_rules(rules: DataFrame, products: DataFrame) -> DataFrame:
    known = products.filter("brand <> 'unknown'").select(F.col("product_id").alias("product_a"), "brand")
    return known.join(rules.select("product_a").distinct(), "product_a", "left_semi").select("brand").distinct().orderBy("brand")


def products_with_rules(rules: DataFrame, products: DataFrame, brand: str, n: int = 50) -> DataFrame:
    own = products.filter(F.col("brand") == brand)
    found = own.join(rules.select(F.col("product_a").alias("product_id")).distinct(), "product_id", "left_semi")
    return found.select("category_code", "product_id").distinct().orderBy("category_code", "product_id").limit(n)


def recommend(rules: DataFrame, products: DataFrame, product_id: int, k: int = 6) -> DataFrame:
    top = rules.filter(F.col("product_a") == product_id).orderBy(F.desc("lift"), "product_b").limit(k)
    return top.join(_named(products, "b"), "product_b").select("product_b", "brand_b", "category_b", "pair_count", "confidence", "lift")


def recommend_all(rules: DataFrame, k: int = 6, products: DataFrame | None = None) -> DataFrame:
    """The k best rules of every product, with brands and categories if the products are given."""
    rank = F.row_number().over(Window.partitionBy("product_a").orderBy(F.desc("lift"), "product_b"))
    top = rules.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top if products is None else top.join(_named(products, "b"), "product_b")
