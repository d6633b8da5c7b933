"""Schemas of the tables that operators exchange."""

GRID = "struct<cols:int,rows:int,bits:binary>"  #: one byte a cell, 0 or 1, row by row
RECT = "struct<left:int,top:int,width:int,height:int>"
OFFSET = "struct<x:int,y:int>"
CELLS = "grid_id long, x int, y int"  #: inked cells only; sizes are in a table of their own
MATRIX = "struct<font:string,rows:int,cols:int,data:array<string>>"
TEMPLATE = (
    "struct<character:string,enclosures:int,lineLeft:boolean,lineRight:boolean,isAmount:boolean,isDate:boolean,"
    f"isDigit:boolean,isLetter:boolean,isPunctuation:boolean,matrices:array<{MATRIX}>>"
)
GLYPH = (
    "struct<x:int,y:int,ax:int,ay:int,cols:int,rows:int,character:string,score:double,needs_inspection:boolean,"
    "was_part_of_split:boolean,bits:binary>"
)
MATCH = "struct<character:string,matrix_index:int,score:double>"
