"""Graph export with resolved edge ends."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from ..graph import Graph
from ..scratch import Scratch
from .basic import graph_stats
from .joins import large


# The page: files as a tree that opens along CONTAINS edges, a search box, and the chosen node with its neighbours.
_PAGE = """<style>body{display:flex;margin:0;font:14px sans-serif}#side{width:38%;height:100vh;overflow:auto;padding:8px}canvas{flex:1;height:100vh}
.n{cursor:pointer;white-space:nowrap}.kids{margin-left:14px}</style>
<div id=side><input id=q placeholder=search size=40><div id=tree></div></div><canvas id=c></canvas>"""
_VIEW = """
const by=new Map(graph.nodes.map(n=>[n.qualified_name,n])),kids=new Map(),ties=new Map(),put=(m,k,v)=>m.has(k)?m.get(k).push(v):m.set(k,[v]);
for(const e of graph.edges){if(e.kind==='CONTAINS')put(kids,e.source_qualified,e.target_qualified);
put(ties,e.source_qualified,[e.kind,e.target_qualified,1]);put(ties,e.target_qualified,[e.kind,e.source_qualified,0])}
function below(q,seen=new Set()){for(const k of kids.get(q)||[])if(!seen.has(k)){seen.add(k);below(k,seen)}return seen}
function row(n,into){const d=document.createElement('div'),t=document.createElement('span'),size=below(n.qualified_name).size;
t.className='n';t.textContent=n.kind+' '+n.name+(size?' ('+size+')':'');d.append(t);into.append(d);
t.onclick=()=>{draw(n.qualified_name);const open=d.querySelector('.kids');if(open)return open.remove();
const box=document.createElement('div');box.className='kids';d.append(box);for(const k of kids.get(n.qualified_name)||[])if(by.has(k))row(by.get(k),box)}}
function list(rows){const tree=document.getElementById('tree');tree.textContent='';let i=0;
(function some(){for(const end=i+500;i<rows.length&&i<end;i++)row(rows[i],tree);if(i<rows.length)requestAnimationFrame(some)})()}
function draw(q){const c=document.getElementById('c'),x=c.getContext('2d'),w=c.width=c.clientWidth,h=c.height=c.clientHeight,own=ties.get(q)||[];
x.font='12px sans-serif';own.forEach(([kind,o,out],i)=>{const a=2*Math.PI*i/own.length,px=w/2+Math.cos(a)*w*.36,py=h/2+Math.sin(a)*h*.42;
x.strokeStyle=out?'#369':'#963';x.beginPath();x.moveTo(w/2,h/2);x.lineTo(px,py);x.stroke();x.fillText(kind+' '+((by.get(o)||{}).name||o),px-30,py)});
x.fillStyle='#000';x.fillText(q,w/2-3*q.length,h/2)}
const files=graph.nodes.filter(n=>n.kind==='File');list(files);
document.getElementById('q').oninput=e=>{const s=e.target.value.toLowerCase();list(s?graph.nodes.filter(n=>n.qualified_name.toLowerCase().includes(s)):files)};
"""


def name_index(nodes: DataFrame) -> DataFrame:
    """(key, qualified_name, place): what a raw target may call a node. ``place`` orders the names of one node."""
    qn, name, fp, kind = F.col("qualified_name"), F.col("name"), F.col("file_path"), F.col("kind")
    module = keys.module_of(fp)
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array(name), F.when(qn.contains("::"), F.array(F.substring_index(qn, "/", -1))).otherwise(none),
        F.when(fp == "", none).when(kind == "File", F.concat(F.array(module), keys.path_suffixes(fp))).otherwise(F.array(F.concat(module, F.lit("."), name))))
    every = nodes.select("qualified_name", F.posexplode(names).alias("place", "key"))
    return every.groupBy("key", "qualified_name").agg(F.min("place").alias("place"))


def _homes(files: DataFrame) -> DataFrame:
    """(home, file): of the given files (file) those whose path begins with another's (home), itself too."""
    begins = F.transform(F.sequence(F.lit(1), F.length("file")), lambda n: F.substr("file", F.lit(1), n))
    every = files.select("file", F.explode(begins).alias("home"))
    return every.join(large(files.select(F.col("file").alias("home"))), "home", "left_semi")


def resolve_edges(g: Graph) -> DataFrame:
    """Edges whose ends are known nodes: a source must be one; a target that isn't is looked up by name. Of several
    candidates one in the source's file wins, then the first by name. Edges that don't resolve are dropped.

    Names and files meet by two joins on equal keys, (name, file) and (name), each with one candidate per key: a
    name that very many files ask for and very many nodes have costs their sum, not their product.
    """
    nodes = g.nodes.select("qualified_name", "name", "file_path", "kind")
    known = nodes.select(F.col("qualified_name").alias("source_qualified"))
    edges = g.edges.select("kind", "source_qualified", "target_qualified", "file_path", "line").join(large(known), "source_qualified", "left_semi")
    exact = nodes.select(F.col("qualified_name").alias("target_qualified"))
    direct = edges.join(large(exact), "target_qualified", "left_semi").withColumn("target", F.col("target_qualified"))
    file_of = lambda c: F.substring_index(c, "::", 1)
    raw = edges.join(large(exact), "target_qualified", "left_anti").withColumn("home", file_of("source_qualified"))
    # Few distinct (target, source file) pairs stand for many edges: resolve those, then join back.
    asked = Scratch(g.spark, "resolve").write(raw.select(F.col("target_qualified").alias("key"), "home").distinct(), "asked")
    # Only names that are asked for meet the files' homes.
    index = name_index(nodes).select("key", "qualified_name").join(large(asked.select("key")), "key", "left_semi")
    least = index.groupBy("key").agg(F.min("qualified_name").alias("far"))
    homes = _homes(nodes.select(file_of("qualified_name").alias("file")).distinct())
    own = index.withColumn("file", file_of("qualified_name")).join(large(homes), "file").groupBy("key", "home").agg(F.min("qualified_name").alias("near"))
    best = asked.join(large(least), "key").join(large(own), ["key", "home"], "left")
    best = best.select(F.col("key").alias("target_qualified"), "home", F.coalesce("near", "far").alias("target"))
    looked = raw.join(large(best), ["target_qualified", "home"])
    shape = ["kind", "source_qualified", "target", "target_qualified", "file_path", "line"]
    return direct.select(*shape).unionByName(looked.select(*shape)).select(
        "kind", "source_qualified", F.col("target").alias("target_qualified"), F.col("target_qualified").alias("raw_target"), "file_path", "line")


def resolved_graph(g: Graph) -> Graph:
    """The graph with resolved edges, on which analytics say more than on raw call texts."""
    return Graph(g.nodes, resolve_edges(g).drop("raw_target"))


def export_nodes(g: Graph) -> DataFrame:
    """Nodes of files that have a File node, one per qualified name."""
    files = g.nodes.filter("kind = 'File'").select("file_path").distinct()
    rows = g.nodes.join(files, "file_path", "left_semi")
    first = F.row_number().over(W.partitionBy("qualified_name").orderBy("id"))
    return rows.withColumn("n", first).filter("n = 1").drop("n")


def write_html(g: Graph, path: str | Path) -> int:
    """A page with the graph as data, for viewing: rows stream to the driver, which writes the file."""
    nodes = export_nodes(g).select("qualified_name", "name", "kind", "file_path", "line_start", "line_end", "language")
    edges = resolve_edges(Graph(export_nodes(g), g.edges)).select("kind", "source_qualified", "target_qualified", "line")
    stats = graph_stats(g).first().asDict(recursive=True)
    n = 0
    with Path(path).open("w") as out:
        out.write("<!DOCTYPE html><meta charset='utf-8'><title>Code graph</title>" + _PAGE + "<script>const graph={\"nodes\":[")
        for name, rows in (("", nodes), ("],\"edges\":[", edges)):
            out.write(name)
            for i, line in enumerate(rows.toJSON().toLocalIterator()):
                out.write(("," if i else "") + line.replace("</", "<\\/"))
                n += 1
        out.write("],\"stats\":" + json.dumps(stats, default=str).replace("</", "<\\/") + ",\"flows\":[],\"communities\":[]};")
        out.write(_VIEW + "</script>")
    return n
