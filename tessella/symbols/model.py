"""Tables of the symbol knowledge base."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()
_TEXTS = T.ArrayType(_S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MEMBER = _struct(name=_S, kind=_S, line=_I, signature=_S, modifiers=_TEXTS, attributes=_TEXTS, isUnityMessage=T.BooleanType())
SYMBOL = _struct(name=_S, kind=_S, namespace=_S, line=_I, endLine=_I, modifiers=_TEXTS, bases=_TEXTS, attributes=_TEXTS, members=T.ArrayType(MEMBER))
FILE_SYMBOLS = _struct(file=_S, relativePath=_S, symbols=T.ArrayType(SYMBOL), usings=_TEXTS, dependencies=_struct(types=_TEXTS, calls=_TEXTS))
FILES = _struct(path=_S, relativePath=_S, size=T.LongType(), lastModified=_S, hash=_S, symbolCount=_I)
META = _struct(name=_S, rootPath=_S, indexedAt=_S, fileCount=_I, symbolCount=_I)
NAMESPACE = _struct(namespace=_S, files=_TEXTS, symbols=T.ArrayType(_struct(name=_S, kind=_S, file=_S, line=_I)))
