"""Query of the media columns; it has no SQL (numpy features)."""
from pyspark.sql import functions as F

from quern.llm.media import media_features, stored, text_media

NAME = "op10_media_columns"


def run(spark, path):
    """The features and NPY tiles are written to the shared folder, too, and read back."""
    media = stored(text_media(spark.read.parquet(f"{path}/documents.parquet")))
    made = stored(media_features(media))
    return made.withColumns({"tile_bytes": F.length("tile").cast("long"), "tile_sha256": F.sha2("tile", 256)}).drop("tile").withColumnRenamed("id", "doc_id")


SQL = None
