from pairloom.functions.hashing import hash_hex, hash_int, hash_unit
from pairloom.functions.vectors import cosine, cosine01, dot, norm, to_double

__all__ = ["cosine", "cosine01", "dot", "hash_hex", "hash_int", "hash_unit", "norm", "to_double"]
