"""Distribution of few rows that are about to become many."""


def spread(df, *columns):
    """Distribute few rows that are about to become many.

    The stated partition count keeps adaptive execution from merging the partitions, whose
    rows are still small.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)
