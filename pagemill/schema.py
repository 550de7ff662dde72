"""Types of rows that pass between stages."""

from pyspark.sql import types as T

#: What a page analysis says. Flags are "Yes" or "No".
FLAGS = ("text_detected", "tables_detected", "images_detected", "latex_equations_detected")
ANALYSIS_FIELDS = (*FLAGS, "extracted_text", "confidence_score_text")
#: Replies are parsed as strings: a confidence in quotes is as good as a number.
RAW_ANALYSIS = T.StructType([T.StructField(f, T.StringType()) for f in ANALYSIS_FIELDS])

PAGE = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("png", T.BinaryType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("rotation", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)

FIGURE = T.StructType([T.StructField("image_url", T.StringType()), T.StructField("base64_encoded", T.StringType())])

REGION = T.StructType(
    [T.StructField(n, T.IntegerType()) for n in ("x", "y", "w", "h", "page_w", "page_h")]
    + [T.StructField(n, T.DoubleType()) for n in ("area", "mean", "std", "lapvar")]
    + [T.StructField("png", T.BinaryType())]
)
