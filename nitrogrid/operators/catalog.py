"""Selecting, categorising and resolving the entries of a product manifest."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.text import (
    any_of, blank_to_null, contains_any, decoded_path, download_file_name, path_authority, path_part,
    path_scheme, title_from_snake,
)
from nitrogrid.operators.ordinals import with_ordinal


def _cell(name):
    return F.col(f"`{name}`")


def _first(columns):
    return F.coalesce(*columns) if columns else F.lit(None).cast("string")


# --- manifests with unknown column names -------------------------------------------------

def column_roles(columns, keywords=None):
    """Role -> columns whose lower-case name contains one of the role's keywords."""
    keywords = K.COLUMN_ROLE_KEYWORDS if keywords is None else keywords
    return {
        role: [c for c in columns if any(word in c.lower() for word in words)]
        for role, words in keywords.items()
    }


def cell_matches(name, keywords):
    return contains_any(F.lower(_cell(name).cast("string")), keywords)


def keyword_entries(df, keywords=None, columns=None):
    """Rows where any single cell contains a keyword, whatever its case."""
    keywords = K.ENTRY_KEYWORDS if keywords is None else keywords
    return df.filter(any_of([cell_matches(c, keywords) for c in (columns or df.columns)]))


def with_first_match(df, keywords=None, columns=None):
    """Add ``match_column, match_value`` of the first matching cell in column order."""
    keywords = K.ENTRY_KEYWORDS if keywords is None else keywords
    first = F.coalesce(*[
        F.when(
            cell_matches(c, keywords),
            F.struct(F.lit(c).alias("name"), _cell(c).cast("string").alias("value")),
        )
        for c in (columns or df.columns)
    ])
    return df.withColumns({"match_column": first["name"], "match_value": first["value"]})


def with_paths(df, roles):
    """Add ``file_path, file_url``: the first non-blank cell of the columns in that role."""
    return df.withColumns({
        "file_path": _first([blank_to_null(_cell(c)) for c in roles["file_path"]]),
        "file_url": _first([blank_to_null(_cell(c)) for c in roles["url"]]),
    })


def with_attributes(df, roles):
    """Add the map ``attributes`` of the present date and product cells."""
    entries = [
        F.struct(F.lit(f"{role}_{c}").alias("key"), _cell(c).cast("string").alias("value"))
        for role in ("date", "product") for c in roles[role]
    ]
    if not entries:
        return df.withColumn("attributes", F.create_map().cast("map<string,string>"))
    present = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return df.withColumn("attributes", F.map_from_entries(present))


def whole_row(df, columns=None):
    """The row as a map of texts, missing cells kept as null."""
    pairs = []
    for c in columns or df.columns:
        pairs += [F.lit(c), _cell(c).cast("string")]
    return F.create_map(*pairs)


def subject_columns(df, keywords=None):
    """Columns whose name mentions the subject: rows ``column``, no data is read."""
    found = column_roles(df.columns, keywords)["subject"]
    names = F.array(*[F.lit(c) for c in found]) if found else F.array().cast("array<string>")
    return df.sparkSession.range(1).select(F.explode(names).alias("column"))


def extract_entries(df, key, roles=None, keywords=None, columns=None):
    """Matching rows with first match, paths, attributes and the whole row.

    ``key`` is the unique integer that orders the manifest. One narrow projection.
    """
    columns = columns or [c for c in df.columns if c != key]
    roles = column_roles(columns) if roles is None else roles
    matched = with_first_match(df, keywords, columns).filter(F.col("match_column").isNotNull())
    return with_attributes(with_paths(matched, roles), roles).select(
        key, "match_column", "match_value", "file_path", "file_url", "attributes",
        whole_row(df, columns).alias("row_data"),
    )


def resolve_files(entries, listing, key):
    """File of each entry: an existing path first, else a name derived from its URL.

    ``listing`` has one row per existing file (``path``), of one folder. An entry names a file by
    its path; scheme and host count where the entry states them. A path that exists as it is
    written comes before the one that its percent escapes give. Adds ``position`` among the
    entries, ``resolved`` and ``origin`` (``local``, ``download`` or null).
    """
    numbered = with_ordinal(entries, key, "position").withColumns({
        "_scheme": path_scheme(F.col("file_path")), "_host": path_authority(F.col("file_path")),
        "_written": path_part(F.col("file_path")), "_decoded": decoded_path(path_part(F.col("file_path"))),
    })
    files = listing.select(
        path_scheme(F.col("path")).alias("_of_scheme"), path_authority(F.col("path")).alias("_of_host"),
        path_part(F.col("path")).alias("_part"), F.col("path").alias("_file"),
    ).distinct()

    def found(form):
        side = files.select(*[F.col(c).alias(f"{c}{form}") for c in files.columns])
        same = (
            (F.col(form) == side[f"_part{form}"])
            & ((F.col("_scheme") == side[f"_of_scheme{form}"]) | ((F.col("_scheme") == "") & ~F.lower(F.trim("file_path")).startswith("file:")))
            & ((F.col("_host") == side[f"_of_host{form}"]) | (F.col("_host") == ""))
        )
        return side, same

    written, as_written = found("_written")
    decoded, as_decoded = found("_decoded")
    joined = numbered.join(written, as_written, "left").join(decoded, as_decoded, "left") \
        .withColumn("_exists", F.coalesce("_file_written", "_file_decoded"))
    origin = F.when(F.col("_exists").isNotNull(), F.lit("local")).when(
        F.col("file_url").isNotNull(), F.lit("download")
    )
    return joined.withColumns({
        "origin": origin,
        "resolved": F.when(F.col("_exists").isNotNull(), F.col("_exists")).when(
            F.col("file_url").isNotNull(), download_file_name(F.col("file_url"), F.col("position"))
        ),
    }).select(*[F.col(f"`{c}`") for c in entries.columns], "position", "origin", "resolved")


def resolved_files(resolved):
    """The distinct files to read: an entry listed twice does not double its rows."""
    return resolved.filter(F.col("resolved").isNotNull()).select("resolved", "origin").distinct()


# --- manifests with the standard headers -----------------------------------------------------

def standard_columns(df, headers=None, row_number="row_number"):
    """Rename the standard headers; an absent column or a missing cell becomes ``''``."""
    headers = K.MANIFEST_COLUMNS if headers is None else headers
    present = [c for c in df.columns if c != row_number]
    return df.select(
        row_number,
        *[
            (F.coalesce(_cell(h).cast("string"), F.lit("")) if h in present else F.lit("")).alias(name)
            for name, h in headers.items()
        ],
        whole_row(df, present).alias("full_row"),
    )


def subject_entries(standard, subject=K.SUBJECT_KEYWORD):
    """Rows whose short name or title mentions the subject."""
    return standard.filter(
        F.upper("short_name").contains(subject) | F.upper("entry_title").contains(subject)
    )


def with_category(entries, rules=None):
    """Add ``category``; the first rule that matches wins."""
    name, title = F.upper("short_name"), F.upper("entry_title")
    rules = K.CATEGORY_RULES if rules is None else rules
    chain = F
    for category, name_words, title_words in rules:
        hit = contains_any(name, name_words) | contains_any(title, title_words)
        chain = chain.when(hit, F.lit(category))
    return entries.withColumn("category", chain.otherwise(F.lit(K.OTHER_CATEGORY)))


def category_counts(categorised):
    """Non-empty categories with title and size.

    The entries stay a long table keyed by ``category``: gathering a category in one array
    would put an unbounded group in one row.
    """
    return categorised.groupBy("category").agg(F.count(F.lit(1)).alias("entries")).withColumn(
        "title", title_from_snake(F.col("category"))
    )


def scan_totals(manifest, subject=K.SUBJECT_KEYWORD):
    """One row: all entries and the entries on the subject, in one pass."""
    hit = F.upper("short_name").contains(subject) | F.upper("entry_title").contains(subject)
    return manifest.agg(
        F.count(F.lit(1)).alias("total_entries"), F.count_if(hit).alias("subject_entries")
    )


def with_instructions(categorised):
    """Add ``instructions``: the text block for one product."""
    lines = [
        F.concat(F.lit(f"{label}: "), F.col(column))
        for label, column in [
            ("Product", "short_name"), ("Title", "entry_title"),
            ("Processing Level", "processing_level"), ("Version", "version"),
            ("Platform", "platform"), ("Start Time", "start_time"), ("End Time", "end_time"),
        ]
    ]
    url = F.when(
        F.col("processing_level") == "3",
        F.concat_ws(
            "\n",
            F.lit("\nDownload URL Pattern:"),
            F.format_string(K.INSTRUCTIONS_URL_PATTERN, F.lower("short_name")),
            F.lit("Look for files ending in .nc (NetCDF format)"),
        ),
    )
    text = F.concat(F.lit("\n"), F.concat_ws("\n", *lines, url, F.lit(K.INSTRUCTIONS_RULE)))
    return categorised.withColumn("instructions", text)


def instruction_sections(categorised, category="no2_products"):
    """The whole document as ordered rows ``section, row_number, text``.

    Joining the texts in (section, row_number) order with newlines gives the document. The
    product list is skipped when it is empty.
    """
    products = categorised.filter(F.col("category") == category)
    texts = with_instructions(products).select(
        F.lit(2).alias("section"), F.col("row_number").cast("long").alias("row_number"),
        F.col("instructions").alias("text"),
    )
    header = products.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit(1), F.lit(0).cast("long"),
        F.concat(F.lit("\nNO2 Products Found: "), F.col("n").cast("string"),
                 F.lit("\n" + K.INSTRUCTIONS_RULE)),
    )
    fixed = categorised.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).alias("section"), F.lit(0).cast("long").alias("row_number"),
                 F.lit(K.INSTRUCTIONS_HEADER).alias("text")),
        F.struct(F.lit(3).alias("section"), F.lit(0).cast("long").alias("row_number"),
                 F.lit(K.INSTRUCTIONS_GENERAL).alias("text")),
    )).alias("s")).select("s.*")
    return texts.union(header).union(fixed)
