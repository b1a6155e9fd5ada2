"""Small frames that several tests build."""


def edges_df(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src bigint, dst bigint")
