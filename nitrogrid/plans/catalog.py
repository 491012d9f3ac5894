"""Manifest reports and the way from a manifest to observations."""

from pyspark.sql import functions as F

from nitrogrid.functions.text import na_to_null
from nitrogrid.operators import catalog as C
from nitrogrid.operators.grid import flatten_grid, rejected_blocks, valid_blocks
from nitrogrid.operators.lineage import with_file_index
from nitrogrid.schemas import OBSERVATION
from nitrogrid.sinks.tables import write_catalog_report
from nitrogrid.sources.files import list_files
from nitrogrid.sources.granules import checked_blocks
from nitrogrid.sources.manifest import read_manifest_texts, with_row_number


def catalog_report(spark, csv_path, out=None):
    """Categorised entries, category sizes and instruction texts of a standard manifest."""
    numbered = with_row_number(read_manifest_texts(spark, csv_path))
    entries = C.with_category(C.subject_entries(C.standard_columns(numbered)))
    counts = C.category_counts(entries)
    sections = C.instruction_sections(entries)
    if out:
        write_catalog_report(entries, counts, sections, out)
    return entries, counts, sections


def manifest_files(spark, csv_path, data_dir):
    """Distinct files that a manifest of unknown shape names."""
    numbered = with_row_number(read_manifest_texts(spark, csv_path), "entry", 0, per_file=False)
    texts = [c for c in numbered.columns if c != "entry"]
    clean = numbered.select("entry", *[
        na_to_null(F.col(f"`{c}`")).alias(c) for c in texts
    ])
    entries = C.extract_entries(clean, "entry")
    return C.resolved_files(C.resolve_files(entries, list_files(spark, data_dir), "entry"))


def observations(spark, folder, pattern="*.parquet", mode="lenient", wanted=None):
    """Observation rows of a folder's granules, and what was left out with the reason.

    A granule that is no usable block and a file that is damaged are rejected whole and reported
    in ``rejected`` (``source_file, error``). ``file_index`` counts them too, so failures leave
    gaps. It is looked up once per block, before the block becomes rows. ``wanted`` (column
    ``path``) restricts the folder to some files.
    """
    checked, faults = checked_blocks(spark, folder, mode, pattern, wanted)
    lost = faults.select(F.col("file_name").alias("source_file"), "error")
    known = checked.select("source_file").unionByName(lost.select("source_file"))
    indexed = with_file_index(valid_blocks(checked), known)
    rows = flatten_grid(indexed, mode, keep=("source_file", "file_index")).select(*OBSERVATION.names)
    return rows, rejected_blocks(checked).unionByName(lost)


def manifest_observations(spark, csv_path, data_dir, pattern="*.parquet", mode="lenient"):
    """From a manifest to observations of the files it names that exist.

    Returns rows, rejected granules, and the entries without a file here (``resolved, origin``).
    A manifest that names no existing file falls back to all files of the folder that match.
    """
    files = manifest_files(spark, csv_path, data_dir)
    local = files.filter("origin = 'local'").select(F.col("resolved").alias("path"))
    rows, rejected = observations(spark, data_dir, pattern, mode, None if local.isEmpty() else local)
    return rows, rejected, files.filter("origin <> 'local'")
