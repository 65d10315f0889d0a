"""Three phases over files, from a shell: python -m tessel.encode --phase N --data FILE --input-metadata FILE --output-metadata FILE [--output FOLDER]

1  proposes metadata for the columns of a delimited table and writes it to the output metadata, for a human to edit
2  refines the input metadata (grids, means and deviations) and writes it to the output metadata; may run again and again
3  encodes inputs by the input metadata and targets by the output metadata, and writes a line of numbers for each row whose target encodes to something, to the output folder

Dictionaries of columns with many values are kept beside the output metadata, in a folder of its name and ".dictionaries".
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessel.operators import features
from tessel.sources import text


def run(spark: SparkSession, phase: int, data: str, input_metadata: str | None, output_metadata: str, output: str | None = None) -> None:
    rows = text.read_table(spark, data)
    if phase == 1:
        text.write_metadata(output_metadata, features.explore(rows, folder=os.path.abspath(output_metadata) + ".dictionaries"))
    elif phase == 2:
        text.write_metadata(output_metadata, features.refine(rows, text.read_metadata(input_metadata)))
    elif phase == 3:
        inputs, targets = text.read_metadata(input_metadata), text.read_metadata(output_metadata)
        if any(isinstance(m.values, features.Dictionary) for m in (*inputs, *targets)):
            both, _ = features.encode_sparse(rows, inputs, "x")
            both, _ = features.encode_sparse(both, targets, "y")
            text.write_sparse(both.filter(F.size("y") > 0), output)
        else:
            text.write_encoded(features.encoded_targets(rows, inputs, targets), output)
    else:
        raise ValueError("phases are 1, 2 and 3")


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--phase", type=int, required=True)
    for name in ("data", "output-metadata"):
        parser.add_argument(f"--{name}", required=True)
    for name in ("input-metadata", "output"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args(arguments)
    if given.phase > 1 and not given.input_metadata or given.phase == 3 and not given.output:
        parser.error("phases 2 and 3 read input metadata, and phase 3 writes to an output folder")
    run(SparkSession.builder.getOrCreate(), given.phase, given.data, given.input_metadata, given.output_metadata, given.output)


if __name__ == "__main__":
    main()
