"""Schemas of symbol columns and tables."""

from __future__ import annotations

import pyarrow as pa

NODE = pa.struct([
    ("pre", pa.int32()), ("parent", pa.int32()), ("ord", pa.int32()), ("depth", pa.int32()), ("size", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("idx", pa.decimal128(20, 0)),
    ("node_hash", pa.string()), ("identity", pa.int32()), ("ino", pa.int32()), ("height", pa.int32()), ("kids", pa.list_(pa.int32())),
])
TREE = pa.list_(NODE)
ERROR = pa.struct([("code", pa.string()), ("at", pa.int32()), ("wanted", pa.string())])
DEMANGLED = pa.struct([("ok", pa.bool_()), ("error", ERROR), ("flavor", pa.string()), ("tree", TREE)])
MANGLED = pa.struct([("mangled", pa.string()), ("error", pa.string())])
SPANS = pa.list_(pa.struct([("text", pa.string()), ("state", pa.string()), ("node_kind", pa.string()), ("parent_kind", pa.string()), ("scope_hash", pa.string())]))
TREE_DDL = "array<struct<pre:int,parent:int,ord:int,depth:int,size:int,kind:string,text:string,idx:decimal(20,0),node_hash:string,identity:int,ino:int,height:int,kids:array<int>>>"
DEMANGLED_DDL = f"struct<ok:boolean,error:struct<code:string,at:int,wanted:string>,flavor:string,tree:{TREE_DDL}>"
MANGLED_DDL = "struct<mangled:string,error:string>"
SPANS_DDL = "array<struct<text:string,state:string,node_kind:string,parent_kind:string,scope_hash:string>>"
