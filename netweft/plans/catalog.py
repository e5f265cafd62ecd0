"""All queries of the network engine and their SQL."""

from . import files, graphs, kernels, runs, stored

QUERIES = {**graphs.QUERIES, **runs.QUERIES, **kernels.QUERIES, **files.QUERIES, **stored.QUERIES}
SQL = {**graphs.SQL, **runs.SQL, **kernels.SQL, **files.SQL, **stored.SQL}
