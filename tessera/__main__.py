"""python -m tessera CONFIG [PARAMS]: runs the stages of the configuration; with --serve it answers HTTP requests instead."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .plans import pipeline, serve
from .sources.config import Configuration


def main(args: list[str]) -> int:
    files = [a for a in args if a != "--serve"]
    if not files or len(files) > 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    config = Configuration(*files)
    pipeline.log_to(f"{config.base}/logs/running_logs.log")
    if "--serve" not in args:
        pipeline.run(spark, config)
        return 0
    model = config["evaluation"].model_path
    serve.server(lambda: pipeline.run(spark, config), lambda text: pipeline.predict(spark, text, pipeline.summarizer_of(spark, model)), "0.0.0.0").serve_forever()  # noqa: S104
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
