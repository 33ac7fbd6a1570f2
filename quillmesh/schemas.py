"""Schemas of the relations."""

FILE = "path string, is_dir boolean, size bigint, text string, link string, error string"
ELEMENT = "path string, ord int, tag string, attrs map<string,string>, line int"
IMAGE_LINK = "path string, start int, end int, line int, raw_target string, target string, target_start int, target_end int, kind string"

#: Parts of a text, an array of them a file.
PARTS = {
    "links": "array<struct<ord:int,line:int,label:string,target:string>>",
    "images": "array<struct<start:int,end:int,line:int,raw_target:string,target:string,target_start:int,target_end:int,kind:string>>",
    "elements": "array<struct<ord:int,tag:string,attrs:map<string,string>,line:int>>",
    "placeholders": "array<struct<ord:int,line:int,placeholder:string>>",
}
