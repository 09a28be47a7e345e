"""Names for columns that go along with those of the user."""

from pyspark.sql import DataFrame


def unused(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it (in any case of letters)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
