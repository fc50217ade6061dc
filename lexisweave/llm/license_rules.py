"""Licence signature rules, in order of priority, written word by word.

A pattern is a list of words separated by spaces. Each word is a regular expression for one whole word of the text
(runs of letters, digits and non-ASCII characters, lower-cased): `x?!` makes the word optional, `...n` stands for up to n words.
A rule applies only where the text has its keyword, a plain word that every match of the rule contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

LICENCE = "licen[cs]es?"

#: Licences: label, keyword, SPDX identifier in words, and the names by which texts call them.
LICENCES: list[tuple[str, str, str, list[str]]] = [
    ("mit", "mit", "mit", [f"mit {LICENCE}", f"mit x11 {LICENCE}"]),
    ("apache-2.0", "apache", "apache 2 0", [f"apache {LICENCE} version?! v?2 0?!", "apache software licen[cs]e version?! v?2 0?!", "apache v?2 0?! licen[cs]e"]),
    ("apache-1.1", "apache", "apache 1 1", [f"apache {LICENCE} version?! v?1 1", "apache software licen[cs]e version?! v?1 1"]),
    ("apache-1.0", "apache", "apache 1 0", [f"apache {LICENCE} version?! v?1 0"]),
    ("gpl-3.0", "general", "gpl 3 0", ["gnu?! general public licen[cs]e version?! v?3 0?!"]),
    ("gpl-2.0", "general", "gpl 2 0", ["gnu?! general public licen[cs]e version?! v?2 0?!"]),
    ("gpl-1.0", "general", "gpl 1 0", ["gnu?! general public licen[cs]e version?! v?1 0?!"]),
    ("lgpl-3.0", "lesser", "lgpl 3 0", ["gnu?! lesser general public licen[cs]e version?! v?3 0?!"]),
    ("lgpl-2.1", "lesser", "lgpl 2 1", ["gnu?! lesser general public licen[cs]e version?! v?2 1"]),
    ("lgpl-2.0", "library", "lgpl 2 0", ["gnu?! library general public licen[cs]e version?! v?2 0?!"]),
    ("agpl-3.0", "affero", "agpl 3 0", ["gnu?! affero general public licen[cs]e version?! v?3 0?!"]),
    ("gfdl-1.3", "documentation", "gfdl 1 3", ["gnu?! free documentation licen[cs]e version?! v?1 3"]),
    ("gfdl-1.2", "documentation", "gfdl 1 2", ["gnu?! free documentation licen[cs]e version?! v?1 2"]),
    ("bsd-2-clause", "bsd", "bsd 2 clause", [f"bsd 2 clause simplified?! {LICENCE}", f"simplified bsd {LICENCE}", f"(?:two|2) clause bsd {LICENCE}"]),
    ("bsd-3-clause", "bsd", "bsd 3 clause", [f"bsd 3 clause {LICENCE}", f"(?:new|modified|revised) bsd {LICENCE}", f"(?:three|3) clause bsd {LICENCE}"]),
    ("bsd-4-clause", "bsd", "bsd 4 clause", [f"bsd 4 clause {LICENCE}", f"(?:four|4) clause bsd {LICENCE}", f"original bsd {LICENCE}"]),
    ("0bsd", "bsd", "0bsd", [f"(?:zero|0) clause bsd {LICENCE}"]),
    ("isc", "isc", "isc", [f"isc {LICENCE}"]),
    ("mpl-2.0", "mozilla", "mpl 2 0", ["mozilla public licen[cs]e version?! v?2 0?!"]),
    ("mpl-1.1", "mozilla", "mpl 1 1", ["mozilla public licen[cs]e version?! v?1 1"]),
    ("epl-2.0", "eclipse", "epl 2 0", ["eclipse public licen[cs]e version?! v?2 0?!"]),
    ("epl-1.0", "eclipse", "epl 1 0", ["eclipse public licen[cs]e version?! v?1 0?!"]),
    ("edl-1.0", "eclipse", "edl 1 0", ["eclipse distribution licen[cs]e version?! v?1 0?!"]),
    ("cddl-1.1", "cddl", "cddl 1 1", ["cddl version?! v?1 1 licen[cs]e"]),
    ("cddl-1.0", "development", "cddl 1 0", ["common development and distribution licen[cs]e version?! v?1 0?!"]),
    ("cpl-1.0", "common", "cpl 1 0", ["common public licen[cs]e version?! v?1 0?!"]),
    ("eupl-1.2", "european", "eupl 1 2", ["european union public licen[cs]e version?! v?1 2"]),
    ("eupl-1.1", "european", "eupl 1 1", ["european union public licen[cs]e version?! v?1 1"]),
    ("artistic-2.0", "artistic", "artistic 2 0", ["artistic licen[cs]e version?! v?2 0?!"]),
    ("artistic-1.0", "artistic", "artistic 1 0", ["artistic licen[cs]e version?! v?1 0?!", "perl artistic licen[cs]e"]),
    ("bsl-1.0", "boost", "bsl 1 0", ["boost software licen[cs]e version?! v?1?! 0?!"]),
    ("busl-1.1", "business", "busl 1 1", ["business source licen[cs]e version?! v?1?! 1?!"]),
    ("zlib", "zlib", "zlib", [f"zlib libpng?! {LICENCE}"]),
    ("unlicense", "unlicense", "unlicense", ["the unlicense licen[cs]e?!"]),
    ("wtfpl", "wtfpl", "wtfpl", ["wtfpl version?! v?2?! licen[cs]e"]),
    ("postgresql", "postgresql", "postgresql", [f"postgresql {LICENCE}"]),
    ("python-2.0", "python", "python 2 0", ["python software foundation licen[cs]e version?! v?2?!", f"psf {LICENCE} python"]),
    ("ruby", "ruby", "ruby", [f"ruby {LICENCE}"]),
    ("php-3.01", "php", "php 3 01", ["php licen[cs]e version?! v?3?! 01?!"]),
    ("openssl", "openssl", "openssl", [f"openssl {LICENCE}"]),
    ("ms-pl", "microsoft", "ms pl", ["microsoft public licen[cs]e"]),
    ("ms-rl", "microsoft", "ms rl", ["microsoft reciprocal licen[cs]e"]),
    ("osl-3.0", "open", "osl 3 0", ["open software licen[cs]e version?! v?3 0?!"]),
    ("afl-3.0", "academic", "afl 3 0", ["academic free licen[cs]e version?! v?3 0?!"]),
    ("ecl-2.0", "educational", "ecl 2 0", ["educational community licen[cs]e version?! v?2 0?!"]),
    ("ofl-1.1", "font", "ofl 1 1", ["sil?! open font licen[cs]e version?! v?1?! 1?!"]),
    ("odbl-1.0", "database", "odbl 1 0", ["open (?:data commons open )?!database licen[cs]e version?! v?1?! 0?!"]),
    ("odc-by-1.0", "attribution", "odc by 1 0", ["open data commons attribution licen[cs]e version?! v?1?! 0?!"]),
    ("ncsa", "illinois", "ncsa", ["university of illinois (?:ncsa )?!open source licen[cs]e"]),
    ("vim", "vim", "vim", [f"vim {LICENCE}"]),
    ("sspl-1.0", "server", "sspl 1 0", ["server side public licen[cs]e version?! v?1?!"]),
    ("elastic-2.0", "elastic", "elastic 2 0", ["elastic licen[cs]e version?! v?2?! 0?!"]),
    ("polyform-nc-1.0", "polyform", "polyform noncommercial 1 0 0", ["polyform noncommercial licen[cs]e"]),
    ("openrail", "openrail", "openrail", ["(?:creativeml|bigscience|bigcode)?! openrail m?! licen[cs]e"]),
    ("llama", "llama", "llama", ["llama v?\\d?! community licen[cs]e"]),
    ("json", "json", "json", [f"json {LICENCE}"]),
    ("beerware", "beer", "beerware", ["beer ware licen[cs]e"]),
    ("upl-1.0", "permissive", "upl 1 0", ["universal permissive licen[cs]e version?! v?1?! 0?!"]),
    ("cecill-2.1", "cecill", "cecill 2 1", ["cecill (?:free software )?!licen[cs]e"]),
    ("hippocratic", "hippocratic", "hippocratic 2 1", [f"hippocratic {LICENCE}"]),
    ("agpl-1.0", "affero", "agpl 1 0", ["affero general public licen[cs]e version?! v?1 0?!"]),
    ("lgpl-3.0", "lgpl", "lgpl 3 0 or later", [f"lgpl v?3 0?! {LICENCE}"]),
    ("lgpl-2.1", "lgpl", "lgpl 2 1 or later", [f"lgpl v?2 1 {LICENCE}"]),
    ("gpl-3.0", "gpl", "gpl 3 0 or later", [f"gpl v?3 0?! {LICENCE}"]),
    ("gpl-2.0", "gpl", "gpl 2 0 or later", [f"gpl v?2 0?! {LICENCE}"]),
    ("agpl-3.0", "agpl", "agpl 3 0 or later", [f"agpl v?3 0?! {LICENCE}"]),
    ("gfdl-1.1", "documentation", "gfdl 1 1", ["gnu?! free documentation licen[cs]e version?! v?1 1"]),
    ("mpl-1.0", "mozilla", "mpl 1 0", ["mozilla public licen[cs]e version?! v?1 0"]),
    ("npl-1.1", "netscape", "npl 1 1", ["netscape public licen[cs]e version?! v?1?! 1?!"]),
    ("ipl-1.0", "ibm", "ipl 1 0", ["ibm public licen[cs]e version?! v?1?! 0?!"]),
    ("spl-1.0", "sun", "spl 1 0", ["sun public licen[cs]e version?! v?1?! 0?!"]),
    ("sissl", "sun", "sissl", ["sun industry standards source licen[cs]e"]),
    ("apsl-2.0", "apple", "apsl 2 0", ["apple public source licen[cs]e version?! v?2?! 0?!"]),
    ("qpl-1.0", "q", "qpl 1 0", ["q public licen[cs]e version?! v?1?! 0?!"]),
    ("rpl-1.5", "reciprocal", "rpl 1 5", ["reciprocal public licen[cs]e version?! v?1?! 5?!"]),
    ("cpal-1.0", "attribution", "cpal 1 0", ["common public attribution licen[cs]e version?! v?1?! 0?!"]),
    ("lpl-1.02", "lucent", "lpl 1 02", ["lucent public licen[cs]e version?! v?1?! 02?!"]),
    ("lppl-1.3c", "latex", "lppl 1 3c", ["latex project public licen[cs]e version?! v?1?! 3c?!"]),
    ("nasa-1.3", "nasa", "nasa 1 3", ["nasa open source agreement version?! v?1?! 3?! licen[cs]e"]),
    ("zpl-2.1", "zope", "zpl 2 1", ["zope public licen[cs]e version?! v?2?! 1?!"]),
    ("w3c", "w3c", "w3c", ["w3c software (?:notice and )?!licen[cs]e", "w3c document licen[cs]e"]),
    ("ijg", "jpeg", "ijg", [f"independent jpeg group {LICENCE}"]),
    ("libpng", "libpng", "libpng 2 0", [f"libpng {LICENCE}"]),
    ("curl", "curl", "curl", [f"curl {LICENCE}"]),
    ("icu", "icu", "icu", [f"icu {LICENCE}"]),
    ("unicode", "unicode", "unicode 3 0", ["unicode (?:data files )?!licen[cs]e", "unicode licen[cs]e agreement"]),
    ("tcl", "tcl", "tcl", ["tcl tk?! licen[cs]e"]),
    ("bzip2-1.0.6", "bzip2", "bzip2 1 0 6", [f"bzip2 {LICENCE}"]),
    ("sleepycat", "sleepycat", "sleepycat", [f"sleepycat {LICENCE}"]),
    ("ssleay", "ssleay", "ssleay", [f"ssleay {LICENCE}"]),
    ("oldap-2.8", "openldap", "oldap 2 8", ["openldap public licen[cs]e version?! v?2?! 8?!"]),
    ("xfree86-1.1", "xfree86", "xfree86 1 1", [f"xfree86 {LICENCE}"]),
    ("x11", "x11", "x11", [f"x11 {LICENCE}"]),
    ("ftl", "freetype", "ftl", ["freetype (?:project )?!licen[cs]e"]),
    ("intel", "intel", "intel", ["intel open source licen[cs]e"]),
    ("ms-lpl", "microsoft", "ms lpl", ["microsoft limited public licen[cs]e"]),
    ("mulan-psl-2.0", "mulan", "mulanpsl 2 0", ["mulan permissive software licen[cs]e version?! v?2?!"]),
    ("ecos-2.0", "ecos", "ecos 2 0", [f"ecos {LICENCE}"]),
    ("erlpl-1.1", "erlang", "erlpl 1 1", ["erlang public licen[cs]e version?! v?1?! 1?!"]),
    ("pddl-1.0", "dedication", "pddl 1 0", ["public domain dedication and licen[cs]e"]),
    ("cdla-permissive-2.0", "community", "cdla permissive 2 0", ["community data licen[cs]e agreement permissive"]),
    ("cdla-sharing-1.0", "community", "cdla sharing 1 0", ["community data licen[cs]e agreement sharing"]),
    ("ogl-3.0", "government", "ogl uk 3 0", ["open government licen[cs]e version?! v?3?! 0?!"]),
    ("etalab-2.0", "ouverte", "etalab 2 0", ["licence ouverte open?! licen[cs]e?! version?! 2?! 0?!"]),
    ("gemma", "gemma", "gemma", ["gemma licen[cs]e"]),
    ("bloom-rail-1.0", "rail", "bloom rail 1 0", ["bigscience rail licen[cs]e version?! v?1?! 0?!"]),
    ("deepseek", "deepseek", "deepseek", ["deepseek licen[cs]e agreement?!"]),
    ("commons-clause", "clause", "commons clause", ["commons clause licen[cs]e condition?!"]),
    ("rsal", "redis", "rsal 2 0", ["redis source available licen[cs]e version?! v?2?! 0?!"]),
    ("confluent", "confluent", "confluent 1 0", ["confluent community licen[cs]e"]),
    ("timescale", "timescale", "timescale", ["timescale licen[cs]e"]),
    ("blue-oak-1.0", "oak", "blueoak 1 0 0", ["blue oak model licen[cs]e"]),
    ("fair", "fair", "fair", ["fair licen[cs]e"]),
    ("ntp", "ntp", "ntp", [f"ntp {LICENCE}"]),
    ("naumen", "naumen", "naumen", ["naumen public licen[cs]e"]),
    ("motosoto", "motosoto", "motosoto", ["motosoto open source licen[cs]e"]),
    ("ricoh-1.0", "ricoh", "rscpl", ["ricoh source code public licen[cs]e"]),
    ("sugarcrm-1.1", "sugarcrm", "sugarcrm 1 1 3", ["sugarcrm public licen[cs]e"]),
    ("vsl-1.0", "vovida", "vsl 1 0", ["vovida software licen[cs]e version?! v?1?! 0?!"]),
    ("watcom-1.0", "watcom", "watcom 1 0", ["sybase open watcom public licen[cs]e"]),
    ("xnet", "net", "xnet", ["x net licen[cs]e"]),
    ("entessa", "entessa", "entessa", ["entessa public licen[cs]e"]),
    ("eu-datagrid", "datagrid", "eudatagrid", ["eu datagrid software licen[cs]e"]),
    ("frameworx-1.0", "frameworx", "frameworx 1 0", ["frameworx open?! licen[cs]e"]),
    ("jabber", "jabber", "jabber", ["jabber open source licen[cs]e"]),
    ("nokia", "nokia", "nokia", ["nokia open source licen[cs]e"]),
    ("oclc-2.0", "oclc", "oclc 2 0", ["oclc research public licen[cs]e"]),
    ("cern-ohl-2.0", "cern", "cern ohl s 2 0", ["cern open hardware licen[cs]e version?! v?2?! 0?!", "cern ohl licen[cs]e"]),
    ("solderpad-2.1", "solderpad", "shl 2 1", ["solderpad hardware licen[cs]e"]),
    ("tapr-ohl-1.0", "tapr", "tapr ohl 1 0", ["tapr open hardware licen[cs]e"]),
    ("free-art-1.3", "art", "lal 1 3", ["free art licen[cs]e version?! 1?! 3?!"]),
    ("sil-gust", "gust", "gust font license", ["gust font licen[cs]e"]),
    ("parity-7.0", "parity", "parity 7 0 0", ["parity public licen[cs]e version?! 7?! 0?! 0?!"]),
    ("prosperity-3.0", "prosperity", "prosperity 3 0 0", ["prosperity public licen[cs]e version?! 3?! 0?! 0?!"]),
    ("polyform-sb-1.0", "polyform", "polyform small business 1 0 0", ["polyform small business licen[cs]e"]),
    ("polyform-perimeter-1.0", "polyform", "polyform perimeter 1 0 0", ["polyform perimeter licen[cs]e"]),
    ("functional-source", "functional", "fsl 1 1", ["functional source licen[cs]e version?! 1?! 1?!"]),
    ("matplotlib", "matplotlib", "matplotlib", [f"matplotlib {LICENCE}"]),
    ("hpnd", "historical", "hpnd", ["historical permission notice and disclaimer"]),
    ("mit-0", "attribution", "mit 0", ["mit no attribution licen[cs]e?!"]),
    ("bsd-patent", "bsd", "bsd 2 clause patent", ["bsd 2 clause plus patent licen[cs]e?!", "bsd plus patent licen[cs]e"]),
    ("bsd-clear", "clear", "bsd 3 clause clear", ["clear bsd licen[cs]e"]),
    ("isc-old", "internet", "isc", ["internet (?:software|systems) consortium licen[cs]e"]),
]

#: Creative Commons deeds: the elements of the short name and their long names.
DEEDS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
DEED_VERSIONS = ("4 0", "3 0", "2 5", "2 0", "1 0")

#: Wordings that stand for themselves: label, keyword, confidence, pattern.
PHRASES: list[tuple[str, str, float, str]] = [
    ("mit", "charge", 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "disclose", 0.9, "permission to use copy modify and or disclose this"),
    ("isc", "distribute", 0.9, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", 0.9, "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "compliance", 1.0, "you may not use this file except in compliance with the licen[cs]e"),
    ("gpl", "redistribute", 1.0, "free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl", "later", 0.9, "general public licen[cs]e ...12 any later version"),
    ("lgpl", "lesser", 0.9, "gnu lesser general public licen[cs]e"),
    ("lgpl", "library", 0.9, "gnu library general public licen[cs]e"),
    ("agpl", "affero", 0.9, "gnu affero general public licen[cs]e"),
    ("gfdl", "documentation", 0.9, "gnu free documentation licen[cs]e"),
    ("mpl", "mozilla", 0.8, "mozilla public licen[cs]e"),
    ("epl", "eclipse", 0.8, "eclipse public licen[cs]e"),
    ("bsd", "bsd", 0.8, f"bsd (?:style )?!{LICENCE}"),
    ("gpl", "gpl", 0.7, "gpl licen[cs]ed?"),
    ("lgpl", "lgpl", 0.7, "lgpl licen[cs]ed?"),
    ("agpl", "agpl", 0.7, "agpl licen[cs]ed?"),
    ("cc0-1.0", "cc0", 0.9, "licen[cs]ed under the?! cc0 1?! 0?!"),
    ("cc0-1.0", "commons", 1.0, "creative commons (?:cc0|zero) licen[cs]e?! 1?! 0?!"),
    ("cc", "commons", 0.7, "creative commons ...6 licen[cs]e"),
    ("public-domain", "domain", 0.8, "(?:dedicated|released|placed) (?:to|into|in) the public domain"),
    ("public-domain", "domain", 0.6, "public domain"),
    ("unlicense", "unencumbered", 1.0, "free and unencumbered software released into the public domain"),
    ("warranty-disclaimer", "warranty", 0.5, "as is without warranty of any kind"),
    ("warranty-disclaimer", "warranties", 0.5, "without warranties or conditions of any kind"),
    ("copyright", "copyright", 0.4, "copyright c?! (?:19|20)\\d\\d"),
    ("all-rights-reserved", "reserved", 0.6, "all rights reserved"),
    ("proprietary", "proprietary", 0.7, "proprietary and confidential ...20 (?:licen[cs]e|copyright|permission)"),
    ("proprietary", "written", 0.5, "without prior?! written permission"),
    ("license-ref", "license", 0.3, "see the?! license file"),
    ("license-ref", "license", 0.3, "license agreement"),
    ("open-source", "source", 0.4, "open source licen[cs]e"),
    ("mit", "notice", 0.9, "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "sublicense", 0.9, "rights to use copy modify merge publish distribute sublicense and or sell copies of the software ...40 permission notice"),
    ("bsd", "retain", 0.9, "redistributions of source code must retain the above copyright notice"),
    ("bsd", "reproduce", 0.9, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "contributors", 0.8, "neither the name of ...12 nor the names of its contributors may be used ...12 without specific prior written permission"),
    ("bsd-4-clause", "advertising", 0.9, "all advertising materials mentioning features or use of this software must display the following ...30 copyright"),
    ("warranty-disclaimer", "merchantability", 0.5, "implied warrant(?:y|ies) of merchantability"),
    ("warranty-disclaimer", "express", 0.5, "any express or implied warranties"),
    ("warranty-disclaimer", "noninfringement", 0.5, "warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-2.0", "perpetual", 0.7, "grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("apache-2.0", "patent", 0.7, "royalty free irrevocable ...8 patent licen[cs]e to make have made use offer to sell"),
    ("apache-2.0", "unless", 0.9, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("gpl", "warranty", 0.9, "distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "copy", 0.8, "you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "copy", 0.9, "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "copy", 0.9, "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", "freedom", 0.8, "the licen[cs]es for most software ...6 are designed to take away your freedom"),
    ("mpl-2.0", "form", 0.9, "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("epl", "accompanying", 0.8, "accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", "cddl", 0.8, "the contents of this file are subject to the terms of the ...8 licen[cs]e ...40 cddl"),
    ("zlib", "altered", 0.9, "altered source versions must be plainly marked as such ...60 warranty"),
    ("zlib", "arising", 0.8, "express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "executable", 0.8, "machine executable object code generated by a source language processor ...60 warranty"),
    ("unlicense", "anyone", 0.9, "anyone is free to copy modify publish use compile sell or distribute this software ...60 public domain"),
    ("cc", "deed", 0.7, "creative commons deed"),
    ("cc0-1.0", "waived", 0.9, "waived all copyright and related ...6 rights"),
    ("cc-by-sa", "sharealike", 0.8, "creative commons attribution sharealike"),
    ("cc-by-sa", "alike", 0.8, "creative commons attribution share alike"),
    ("cc-by-nc", "noncommercial", 0.8, "creative commons attribution noncommercial"),
    ("cc-by-nc", "commercial", 0.8, "creative commons attribution non commercial"),
    ("cc-by", "attribution", 0.7, "creative commons attribution licen[cs]e"),
    ("public-domain", "domain", 0.8, "i grant ...12 released into the public domain"),
    ("public-domain", "domain", 0.7, "has been placed in the public domain"),
    ("public-domain", "government", 0.7, "work of the united?! states?! u?! s?! us?! government ...20 public domain"),
    ("public-domain", "copyright", 0.6, "no copyright is claimed"),
    ("proprietary", "unauthorized", 0.7, "unauthorized copying of this file ...20 (?:permission|copyright|licen[cs]e)"),
    ("proprietary", "trade", 0.6, "trade secrets? ...20 (?:licen[cs]e|permission)"),
    ("proprietary", "redistributed", 0.6, "may not be (?:copied|reproduced|redistributed) ...10 without ...8 permission"),
    ("proprietary", "internal", 0.6, "for internal use only ...12 rights reserved"),
    ("proprietary", "eula", 0.6, "end user licen[cs]e agreement eula"),
    ("proprietary", "commercial", 0.5, "commercial licen[cs]e"),
    ("evaluation", "evaluation", 0.5, "evaluation licen[cs]e"),
    ("academic", "academic", 0.5, "academic licen[cs]e"),
    ("research-only", "research", 0.6, "licen[cs]ed? for (?:non commercial )?!research (?:purposes|use) only"),
    ("non-commercial", "commercial", 0.6, "non commercial (?:use|purposes) only ...12 licen[cs]e"),
    ("no-derivatives", "derivative", 0.5, "no derivative works ...12 licen[cs]e"),
    ("dual", "dual", 0.6, "dual licen[cs]ed"),
    ("license-ref", "file", 0.4, "licen[cs]ed? under the ...6 licen[cs]e found in the licen[cs]e file"),
    ("license-ref", "details", 0.3, "see licen[cs]e txt?! md?! for details"),
    ("license-ref", "terms", 0.3, "terms of the licen[cs]e"),
    ("license-ref", "spdx", 0.4, "spdx licen[cs]e identifier licenseref"),
    ("copyright", "copyright", 0.3, "copyright holders?"),
    ("copyright", "contributors", 0.4, "copyright ...6 contributors"),
    ("copyright", "owner", 0.3, "copyright owner"),
    ("gpl-exception", "classpath", 0.8, "classpath exception ...40 licen[cs]e"),
    ("gpl-exception", "linking", 0.7, "licen[cs]e ...12 linking exception"),
    ("llvm-exception", "llvm", 0.9, "llvm exceptions? ...8 licen[cs]e"),
    ("patent-grant", "patent", 0.6, "additional grant of patent rights ...40 licen[cs]e"),
    ("trademark", "trademarks", 0.3, "trademarks ...20 rights reserved"),
]

#: The three phrases whose places are counted whatever else is found, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: A text in which none of these occurs has none of the rules' matches (a rule's gate is the one that its matches contain).
GATES = ("licen[cs]", "copyright", "spdx", "warrant", "rights[^0-9a-z\\x{80}-\\x{10FFFF}]+reserved", "public[^0-9a-z\\x{80}-\\x{10FFFF}]+domain", "permi(?:ssion|tted)", "creative[^0-9a-z\\x{80}-\\x{10FFFF}]+commons")


@dataclass(frozen=True)
class Rule:
    order: int
    tier: int  # 0 first: statements of licensing, 1 names and identifiers, 2 wordings, 3 weak signs
    label: str
    keyword: str
    confidence: float
    pattern: str
    base: bool = False

    @property
    def regex(self) -> str:
        """The pattern over words that each have a space before and after."""
        return words_regex(self.pattern)


def words_regex(pattern: str) -> str:
    out = []
    for word in re.findall(r"(?:\((?:[^()]|\([^()]*\))*\)|\[[^\]]*\]|[^\s()\[\]])+", pattern):
        if m := re.fullmatch(r"\.\.\.(\d+)", word):
            out.append(f"(?: [^ ]+ ){{0,{m[1]}}}")
        elif m := re.fullmatch(r"\(\?:([^|()]+) \)\?!(.+)", word):  # optional words and what follows
            out.append("(?:" + "".join(f" {w} " for w in m[1].split(" ")) + f")? {m[2]} ")
        elif word.endswith("?!"):
            out.append(f"(?: {word[:-2]} )?")
        else:
            out.append(f" {word} ")
    return "".join(out)


def rules() -> list[Rule]:
    """All rules in order of priority: licensing statements, names and identifiers, wordings, base phrases."""
    said = "(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed) (?:under|by|with) ...4 "
    stated, named = [], []
    for label, keyword, spdx, names in LICENCES:
        named.append((1, label, "spdx", 1.0, f"spdx licen[cs]e identifier {spdx}"))
        for name in names:
            stated.append((0, label, keyword, 1.0, said + name))
            named.append((1, label, keyword, 0.9, name))
    for deed, long in DEEDS.items():
        for version in DEED_VERSIONS:
            label = f"cc-{deed.replace(' ', '-')}-{version.replace(' ', '.')}"
            stated.append((0, label, "cc", 1.0, f"licen[cs]ed under ...2 cc {deed} {version}"))
            named.append((1, label, "commons", 1.0, f"creative commons {long} {version}"))
            named.append((1, label, "spdx", 1.0, f"spdx licen[cs]e identifier cc {deed} {version}"))
    weak = [(2 if c >= 0.7 else 3, label, keyword, c, p) for label, keyword, c, p in PHRASES]
    found = [Rule(i, t, label, k, c, p) for i, (t, label, k, c, p) in enumerate([*stated, *named, *weak])]
    return [*found, *(Rule(len(found) + i, 2, label, "license", 0.6, p, True) for i, (p, label) in enumerate(BASE))]
