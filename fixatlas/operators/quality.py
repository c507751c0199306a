"""Quality checks.  Each returns the offending rows, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatlas import fixed
from fixatlas.functions.text import let, strip

# Declared fields of a tracker document, required ones first.
ROOT_FIELDS = ["metadata", "products"]
METADATA_FIELDS = ["generated_at", "version", "source"]
PRODUCT_FIELDS = ["id", "name", "versions"]
VERSION_FIELDS = ["version", "release_date", "known_issues", "addressed_issues"]
ISSUE_FIELDS = [
    "bug_id", "description", "symptoms", "workaround", "fix_info", "affected_components",
    "release_date",
]


def _opened(doc: Column, *fields: str) -> Column:
    """``struct(keys, <field>, ..)`` of a document: its field names, and the text of some of its fields.

    One pass over the text. It is searched for a field only if it can't be read to its end, or holds
    the field as null, which may come again.
    """
    def read(x):
        keys = F.when(x["map"].isNotNull(), F.map_keys(x["map"])).otherwise(
            F.coalesce(F.json_object_keys(x["doc"]), _none())  # what is no object has no fields
        )

        def text(f):
            again = x["map"].isNull() | F.map_contains_key(x["map"], f)
            found = F.try_element_at(x["map"], F.lit(f))
            return F.coalesce(found, F.when(again, F.get_json_object(x["doc"], f"$.{f}")))

        return F.struct(keys.alias("keys"), *[text(f).alias(f) for f in fields])

    return let(F.struct(doc.alias("doc"), F.from_json(doc, "map<string,string>").alias("map")), read)


def _problems(keys: Column, declared: list[str], required: list[str]) -> Column:
    allowed, needed = (F.array(*[F.lit(f) for f in x]) for x in (declared, required))
    return F.concat(
        F.transform(F.array_except(keys, allowed), lambda k: F.concat(F.lit("undeclared "), k)),
        F.transform(F.array_except(needed, keys), lambda k: F.concat(F.lit("missing "), k)),
    )


def _members(listed: Column) -> Column:
    """Members of a JSON list, each still as JSON text."""
    return F.coalesce(F.from_json(listed, "array<string>"), _none())


def _none() -> Column:
    return F.array().cast("array<string>")


def _found(level: str, problems: Column) -> Column:
    return F.transform(problems, lambda p: F.struct(F.lit(level).alias("level"), p.alias("problem")))


def _of_product(product: Column) -> Column:
    """Problems of a product document and of all in it, as one array; every text is read once."""
    lists = ("known_issues", "addressed_issues")

    def of_issue(i):
        return _found("issue", _problems(_opened(i)["keys"], ISSUE_FIELDS, ["bug_id", "description"]))

    def of_version(v):
        return F.struct(
            _found("version", _problems(v["keys"], VERSION_FIELDS, ["version"])).alias("own"),
            F.flatten(F.transform(F.concat(*[_members(v[f]) for f in lists]), of_issue)).alias("issues"),
        )

    def of_product(p):
        return F.struct(
            _found("product", _problems(p["keys"], PRODUCT_FIELDS, ["id", "name"])).alias("own"),
            F.transform(
                _members(p["versions"]), lambda v: let(_opened(v, *lists), of_version)
            ).alias("versions"),
        )

    return let(let(_opened(product, "versions"), of_product), lambda p: F.concat(
        p["own"],
        F.flatten(F.transform(p["versions"], lambda v: v["own"])),
        F.flatten(F.transform(p["versions"], lambda v: v["issues"])),
    ))


def strict_schema(documents: DataFrame, doc: str = "value") -> DataFrame:
    """Undeclared and missing fields of product documents, at every level, in one pass."""
    return documents.select(
        F.get_json_object(doc, "$.id").alias("product_id"), F.explode(_of_product(F.col(doc))).alias("_f")
    ).select("product_id", "_f.*")


def strict_root(files: DataFrame, doc: str = "value") -> DataFrame:
    """Undeclared and missing fields of whole-file documents, of their metadata and of their products."""
    def problems(x):
        metadata = _found("metadata", _problems(_opened(x["metadata"])["keys"], METADATA_FIELDS, []))
        return F.concat(
            _found("root", _problems(x["keys"], ROOT_FIELDS, ["products"])),
            F.when(x["metadata"].isNotNull(), metadata).otherwise(_found("metadata", _none())),
            F.flatten(F.transform(_members(x["products"]), _of_product)),
        )

    top = let(_opened(F.col(doc), "metadata", "products"), problems)
    kept = [c for c in files.columns if c != doc]
    return files.select(*kept, F.explode(top).alias("_f")).select(*kept, "_f.*")


def _kind(parsed: Column, field: str | None = None) -> Column:
    """OBJECT, ARRAY, STRING, ... of a parsed document or a field of it; null if unreadable or absent."""
    value = parsed if field is None else F.try_variant_get(parsed, f"$.{field}", "variant")
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _is(kind: Column, *names: str) -> Column:
    return F.coalesce(kind.isin(*names), F.lit(False))


def _product_problem(doc: Column) -> Column:
    return let(F.try_parse_json(doc), lambda p: (
        F.when(~_is(_kind(p), "OBJECT"), "not an object")
        .when(~_is(_kind(p, "id"), "STRING"), "id is not a text")
        .when(~_is(_kind(p, "name"), "STRING"), "name is not a text")
        .when(~_is(_kind(p, "versions"), "ARRAY"), "versions is not a list")
    ))


def _with_problem(documents: DataFrame, problem: Column) -> DataFrame:
    """Rows that have a problem.

    Exploded and not filtered: a filter would be pushed below the column and test each document by
    building and reading it once more.
    """
    return documents.select("*", F.explode(F.array_compact(F.array(problem))).alias("problem"))


def shape(documents: DataFrame, doc: str = "value") -> DataFrame:
    """Products that are no object, or whose id or name is not a text or whose versions are not a list."""
    return _with_problem(documents, _product_problem(F.col(doc)))


def root_shape(files: DataFrame, doc: str = "value") -> DataFrame:
    """Whole-file documents that can't be shown, with the first problem of the root or of a product.

    The metadata has to be an object, if there is one, and the list of products must not be empty.
    """
    def problem(x):
        first = F.get(F.array_compact(F.transform(x["products"], _product_problem)), F.lit(0))
        return (
            F.when(~_is(x["root"], "OBJECT"), "root is not an object")
            .when(~_is(x["list"], "ARRAY"), "products is not a list")
            .when(F.size(x["products"]) == 0, "no products")
            .when(x["metadata"].isNotNull() & ~_is(x["metadata"], "OBJECT"), "metadata is not an object")
            .otherwise(first)
        )

    def kinds(p):
        return F.struct(
            _kind(p).alias("root"),
            _kind(p, "products").alias("list"),
            _kind(p, "metadata").alias("metadata"),
            _members(F.get_json_object(doc, "$.products")).alias("products"),
        )

    return _with_problem(files, let(let(F.try_parse_json(doc), kinds), problem))


def bad_generated_at(metadata: DataFrame, now: Column) -> DataFrame:
    """Metadata whose timestamp is missing, unreadable or over an hour ahead."""
    at = F.try_to_timestamp("generated_at")
    problem = (
        F.when(F.col("generated_at").isNull() | (F.col("generated_at") == ""), "missing")
        .when(at.isNull(), "unreadable")
        .when(F.unix_micros(at) > F.unix_micros(now) + 3_600_000_000, "in the future")
    )
    return metadata.withColumn("problem", problem).filter("problem is not null")


def duplicate_products(products: DataFrame) -> DataFrame:
    return (
        products.groupBy("product_id")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def bad_products(products: DataFrame, issues: DataFrame) -> DataFrame:
    """Products without id, name or version, and ids used twice."""
    def blank(c):
        return F.col(c).isNull() | (F.col(c) == "")

    with_versions = issues.filter(~blank("version")).select("product_id").distinct()
    named = products.select("product_id", "product_name")
    parts = [
        named.filter(blank("product_id")).withColumn("problem", F.lit("no id")),
        named.filter(blank("product_name")).withColumn("problem", F.lit("no name")),
        named.join(with_versions, "product_id", "left_anti").withColumn(
            "problem", F.lit("no version")
        ),
        duplicate_products(products).select(
            "product_id", F.lit(None).cast("string").alias("product_name"),
            F.lit("duplicate id").alias("problem"),
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bad_versions(issues: DataFrame, tolerated: list[str] | None = None) -> DataFrame:
    """Distinct versions that are missing or misspelt outside the tolerated products."""
    tolerated = fixed.VERSION_TOLERATED if tolerated is None else tolerated
    version = F.coalesce("version", F.lit(""))
    bad = (version == "") | (
        ~version.rlike(fixed.VERSION_QUALITY) & ~F.col("product_id").isin(tolerated)
    )
    return issues.filter(bad).select("product_id", "version").distinct()


def empty_versions(versions: DataFrame, issues: DataFrame) -> DataFrame:
    """Declared versions without an issue on either side."""
    return versions.select("product_id", "version").distinct().join(
        issues.select("product_id", "version").distinct(), ["product_id", "version"], "left_anti"
    )


def bad_bug_ids(issues: DataFrame) -> DataFrame:
    """Rows without an identifier or with one that is not PREFIX-NUMBER."""
    bug_id = strip(F.coalesce("bug_id", F.lit("")))
    problem = F.when(bug_id == "", "missing").when(
        ~bug_id.rlike(fixed.BUG_ID_QUALITY), "misspelt"
    )
    return issues.withColumn("problem", problem).filter("problem is not null")


def blank_descriptions(issues: DataFrame) -> DataFrame:
    return issues.filter(strip(F.coalesce("description", F.lit(""))) == "")


def pages_without_issues(pages: DataFrame, issues: DataFrame, key: str = "url") -> DataFrame:
    """Usable pages nothing was extracted from: kept as failures of the load."""
    return (
        pages.join(issues.select(key).distinct(), key, "left_anti")
        .withColumn("error", F.lit("no issues parsed"))
    )


def unexpected_majors(seen: DataFrame, expected: DataFrame) -> DataFrame:
    """Majors seen but not expected, and expected but not seen."""
    keys = ["product_id", "major_version"]
    return (
        seen.select(*keys).distinct()
        .join(expected.select(*keys), keys, "left_anti")
        .withColumn("problem", F.lit("unexpected"))
        .unionByName(
            expected.select(*keys)
            .join(seen.select(*keys).distinct(), keys, "left_anti")
            .withColumn("problem", F.lit("not seen"))
        )
    )


# Checks of single issues, each with the test that finds an offending row.
def _row_tests(tolerated: list[str]) -> dict[str, Column]:
    bug_id, version = strip(F.coalesce("bug_id", F.lit(""))), F.coalesce("version", F.lit(""))
    return {
        "id missing": bug_id == "",
        "id misspelt": (bug_id != "") & ~bug_id.rlike(fixed.BUG_ID_QUALITY),
        "description blank": strip(F.coalesce("description", F.lit(""))) == "",
        "version missing": version == "",
        "version misspelt": (version != "") & ~version.rlike(fixed.VERSION_QUALITY)
        & ~F.coalesce(F.col("product_id").isin(tolerated), F.lit(False)),
    }


def summary_by_version(
    issues: DataFrame, products: DataFrame, declared: DataFrame, tolerated: list[str] | None = None
) -> DataFrame:
    """One row for each product and version with the counts all checks need, from one scan of each table.

    Rows of ``products`` have no version; those without a name count apart.
    """
    tests = _row_tests(fixed.VERSION_TOLERATED if tolerated is None else tolerated)
    counts = ["issues", *tests, "declared", "products", "nameless"]

    def tagged(rows, version, **values):
        zero = F.lit(0).cast("bigint")
        return rows.select("product_id", version.alias("version"), *[values.get(c, zero).cast("bigint").alias(c) for c in counts])

    none, one = F.lit(None).cast("string"), F.lit(1)
    nameless = (F.coalesce("product_name", F.lit("")) == "").cast("bigint")
    rows = (
        tagged(issues, F.col("version"), issues=one, **{c: test.cast("bigint") for c, test in tests.items()})
        .unionByName(tagged(declared, F.col("version"), declared=one))
        .unionByName(tagged(products, none, products=one, nameless=nameless))
    )
    return rows.groupBy("product_id", "version").agg(*[F.sum(c).alias(c) for c in counts])


def all_checks(summary: DataFrame) -> DataFrame:
    """check, product_id, version (null for checks of products), n of everything that is not as it should be.

    ``summary`` is that of ``summary_by_version``, best stored: it is small and read for versions and for products.
    """
    def findings(tests):
        return F.filter(F.array(*[F.struct(F.lit(c).alias("check"), n.alias("n")) for c, n in tests.items()]), lambda f: f["n"] > 0)

    by_version = {c: F.col(f"`{c}`") for c in ("id missing", "id misspelt", "description blank", "version missing", "version misspelt")}
    by_version["version without issues"] = F.when(F.col("issues") == 0, F.col("declared"))
    versions = summary.select("product_id", "version", F.explode(findings(by_version)).alias("_f"))
    held = F.count_if((F.col("issues") > 0) & (F.coalesce("version", F.lit("")) != ""))
    products = summary.groupBy("product_id").agg(
        F.sum("products").alias("products"), F.sum("nameless").alias("nameless"), held.alias("held")
    ).where("products > 0")
    by_product = {
        "product without id": F.when(F.coalesce("product_id", F.lit("")) == "", F.col("products")),
        "product without name": F.col("nameless"),
        "product without version": F.when(F.col("held") == 0, F.col("products")),
        "product id used twice": F.when(F.col("products") > 1, F.col("products")),
    }
    named = products.select("product_id", F.lit(None).cast("string").alias("version"), F.explode(findings(by_product)).alias("_f"))
    return versions.unionByName(named).select("_f.check", "product_id", "version", "_f.n")
