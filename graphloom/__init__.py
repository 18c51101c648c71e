"""RDF, SPARQL and training-data operators on Spark."""

from .catalog import Catalog, MappingError
from .convert import hdt2ttl, hdtcat, ttl2hdt
from .dataset import PreparedQuery, SparkDataset, build_catalog, dataset, prepare, query
from .terms import decode_term, encode_term

__all__ = ["Catalog", "MappingError", "PreparedQuery", "SparkDataset", "build_catalog", "dataset", "decode_term", "encode_term", "hdt2ttl", "hdtcat", "prepare", "query", "ttl2hdt"]
