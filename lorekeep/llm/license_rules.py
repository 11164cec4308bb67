"""The signature rules of the license scan, written out by hand.

A line is ``label | keywords | weight | pattern``. Patterns are regular expressions over a text's words, lower-cased and
joined by single spaces (punctuation is gone: "as-is" is "as is", "v2.0" is "v2 0"); they match whole words. A rule is
tried only on texts that hold one of its keywords, and a match holds one, too. Rules stand in four groups by priority; in
a group, earlier ones win ties. The wording is that of the licenses' own texts, of the notices they ask for, and of the
short forms in which headers, manifests and web pages name them.
"""

from __future__ import annotations

# {L}: license in both spellings; {V}: a version word; {LATER}: later versions; {OSI}: the addresses of license lists.
_SHORT = {
    "{L}": "licen[sc]e",
    "{V}": "(?:v|ver|version |v )?",
    "{LATER}": "(?: (?:or (?:at your option )?(?:any )?later(?: version)?|only|and later))?",
    "{OSI}": "(?:opensource org licenses?|spdx org licenses|choosealicense com licenses)",
    "{GRANT}": "(?:(?:is|are|be|was|were) )?(?:dual )?(?:licensed|released|distributed|available|provided|covered|published|redistributed|governed|shared|offered|made available)(?: only)? (?:under|by|with|through)(?: the)?(?: terms (?:and conditions )?of)?(?: the)?(?: following)?",
}

#: Tags that machines read: SPDX lines, manifest fields, addresses.
TAGS = r"""
gpl-1.0 | spdx | 1.0 | spdx {L} identifier gpl 1 0(?: only| or later)?
gpl-2.0 | spdx | 1.0 | spdx {L} identifier gpl 2 0(?: only| or later)?(?: with (?:linux syscall note|classpath exception 2 0|gcc exception 2 0|autoconf exception 2 0))?
gpl-3.0 | spdx | 1.0 | spdx {L} identifier gpl 3 0(?: only| or later)?(?: with (?:gcc exception 3 1|autoconf exception 3 0))?
lgpl-2.0 | spdx | 1.0 | spdx {L} identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | spdx | 1.0 | spdx {L} identifier lgpl 2 1(?: only| or later)?
lgpl-3.0 | spdx | 1.0 | spdx {L} identifier lgpl 3 0(?: only| or later)?
agpl-3.0 | spdx | 1.0 | spdx {L} identifier agpl 3 0(?: only| or later)?
gfdl-1.2 | spdx | 1.0 | spdx {L} identifier gfdl 1 2(?: only| or later)?
gfdl-1.3 | spdx | 1.0 | spdx {L} identifier gfdl 1 3(?: only| or later)?
apache-1.1 | spdx | 1.0 | spdx {L} identifier apache 1 1
apache-2.0 | spdx | 1.0 | spdx {L} identifier apache 2 0(?: with llvm exception)?
mit-0 | spdx | 1.0 | spdx {L} identifier mit 0
mit | spdx | 1.0 | spdx {L} identifier mit
isc | spdx | 1.0 | spdx {L} identifier isc
0bsd | spdx | 1.0 | spdx {L} identifier 0bsd
bsd-2-clause | spdx | 1.0 | spdx {L} identifier bsd 2 clause(?: patent| views)?
bsd-3-clause | spdx | 1.0 | spdx {L} identifier bsd 3 clause(?: clear| lbnl)?
bsd-4-clause | spdx | 1.0 | spdx {L} identifier bsd 4 clause(?: uc)?
mpl-1.1 | spdx | 1.0 | spdx {L} identifier mpl 1 1
mpl-2.0 | spdx | 1.0 | spdx {L} identifier mpl 2 0(?: no copyleft exception)?
epl-1.0 | spdx | 1.0 | spdx {L} identifier epl 1 0
epl-2.0 | spdx | 1.0 | spdx {L} identifier epl 2 0
eupl-1.1 | spdx | 1.0 | spdx {L} identifier eupl 1 1
eupl-1.2 | spdx | 1.0 | spdx {L} identifier eupl 1 2
cddl-1.0 | spdx | 1.0 | spdx {L} identifier cddl 1 0
cddl-1.1 | spdx | 1.0 | spdx {L} identifier cddl 1 1
cpl-1.0 | spdx | 1.0 | spdx {L} identifier cpl 1 0
artistic-1.0 | spdx | 1.0 | spdx {L} identifier artistic 1 0(?: perl| cl8)?
artistic-2.0 | spdx | 1.0 | spdx {L} identifier artistic 2 0
bsl-1.0 | spdx | 1.0 | spdx {L} identifier bsl 1 0
zlib | spdx | 1.0 | spdx {L} identifier zlib
libpng | spdx | 1.0 | spdx {L} identifier libpng(?: 2 0)?
unlicense | spdx | 1.0 | spdx {L} identifier unlicense
wtfpl | spdx | 1.0 | spdx {L} identifier wtfpl
cc0-1.0 | spdx | 1.0 | spdx {L} identifier cc0 1 0
cc-by-4.0 | spdx | 1.0 | spdx {L} identifier cc by 4 0
cc-by-3.0 | spdx | 1.0 | spdx {L} identifier cc by 3 0
cc-by-sa-4.0 | spdx | 1.0 | spdx {L} identifier cc by sa 4 0
cc-by-sa-3.0 | spdx | 1.0 | spdx {L} identifier cc by sa 3 0
cc-by-nc-4.0 | spdx | 1.0 | spdx {L} identifier cc by nc 4 0
cc-by-nd-4.0 | spdx | 1.0 | spdx {L} identifier cc by nd 4 0
cc-by-nc-sa-4.0 | spdx | 1.0 | spdx {L} identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | spdx | 1.0 | spdx {L} identifier cc by nc nd 4 0
ofl-1.1 | spdx | 1.0 | spdx {L} identifier ofl 1 1(?: rfn| no rfn)?
odbl-1.0 | spdx | 1.0 | spdx {L} identifier odbl 1 0
pddl-1.0 | spdx | 1.0 | spdx {L} identifier pddl 1 0
psf-2.0 | spdx | 1.0 | spdx {L} identifier (?:psf|python) 2 0
postgresql | spdx | 1.0 | spdx {L} identifier postgresql
openssl | spdx | 1.0 | spdx {L} identifier openssl
php-3.01 | spdx | 1.0 | spdx {L} identifier php 3 0?1
ruby | spdx | 1.0 | spdx {L} identifier ruby
ncsa | spdx | 1.0 | spdx {L} identifier ncsa
ms-pl | spdx | 1.0 | spdx {L} identifier ms pl
ms-rl | spdx | 1.0 | spdx {L} identifier ms rl
busl-1.1 | spdx | 1.0 | spdx {L} identifier busl 1 1
sspl-1.0 | spdx | 1.0 | spdx {L} identifier sspl 1 0
elastic-2.0 | spdx | 1.0 | spdx {L} identifier elastic 2 0
vim | spdx | 1.0 | spdx {L} identifier vim
beerware | spdx | 1.0 | spdx {L} identifier beerware
other-spdx | spdx | 0.7 | spdx {L} identifier {L}ref(?: [^ ]+){1,3}
mit | license licence | 0.95 | {L} (?:mit|file mit|text mit|type mit) (?:author|version|name|description|url|homepage|repository|classifiers)
mit | classifier | 1.0 | classifier {L} osi approved mit {L}
apache-2.0 | classifier | 1.0 | classifier {L} osi approved apache software {L}
bsd | classifier | 1.0 | classifier {L} osi approved bsd {L}
gpl-2.0 | classifier | 1.0 | classifier {L} osi approved gnu general public {L} v2(?: or later)? gplv2
gpl-3.0 | classifier | 1.0 | classifier {L} osi approved gnu general public {L} v3(?: or later)? gplv3
lgpl-3.0 | classifier | 1.0 | classifier {L} osi approved gnu lesser general public {L} v3(?: or later)? lgplv3
agpl-3.0 | classifier | 1.0 | classifier {L} osi approved gnu affero general public {L} v3(?: or later)?
mpl-2.0 | classifier | 1.0 | classifier {L} osi approved mozilla public {L} 2 0 mpl 2 0
isc | classifier | 1.0 | classifier {L} osi approved isc {L}
proprietary | classifier | 1.0 | classifier {L} other proprietary {L}
"""

#: What grants a license by name, and where its text is.
GRANTS = r"""
gpl-3.0 | license licence gpl | 0.95 | {GRANT} (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}3(?: 0)?{LATER}
gpl-2.0 | license licence gpl | 0.95 | {GRANT} (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}2(?: 0)?{LATER}
gpl-1.0 | license licence gpl | 0.95 | {GRANT} (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}1(?: 0)?{LATER}
lgpl-3.0 | lesser lgpl lgplv3 | 0.95 | {GRANT} (?:gnu )?(?:lesser general public {L}(?: lgpl)?|lgpl) {V}3(?: 0)?{LATER}
lgpl-2.1 | lesser lgpl lgplv2 | 0.95 | {GRANT} (?:gnu )?(?:lesser general public {L}(?: lgpl)?|lgpl) {V}2 1{LATER}
lgpl-2.0 | library lgpl lgplv2 | 0.95 | {GRANT} (?:gnu )?(?:library general public {L}(?: lgpl)?|lgpl) {V}2(?: 0)?{LATER}
agpl-3.0 | affero agpl agplv3 | 0.95 | {GRANT} (?:gnu )?(?:affero general public {L}(?: agpl)?|agpl) {V}3(?: 0)?{LATER}
gfdl-1.3 | documentation gfdl fdl | 0.95 | {GRANT} (?:gnu )?(?:free documentation {L}|gfdl|fdl) {V}1 3{LATER}
gfdl-1.2 | documentation gfdl fdl | 0.95 | {GRANT} (?:gnu )?(?:free documentation {L}|gfdl|fdl) {V}1 2{LATER}
gfdl-1.1 | documentation gfdl fdl | 0.95 | {GRANT} (?:gnu )?(?:free documentation {L}|gfdl|fdl) {V}1 1{LATER}
agpl | affero agpl | 0.9 | {GRANT} (?:gnu )?(?:affero general public {L}|agpl)
lgpl | lesser library lgpl | 0.9 | {GRANT} (?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)
gpl | gnu gpl general | 0.9 | {GRANT} (?:gnu )?(?:general public {L}|gpl)
gfdl | documentation gfdl | 0.9 | {GRANT} (?:gnu )?(?:free documentation {L}|gfdl)
apache-2.0 | apache | 0.95 | {GRANT} apache (?:software )?(?:{L} )?{V}2(?: 0)?(?: {L})?
apache-1.1 | apache | 0.95 | {GRANT} apache (?:software )?{L} {V}1 1
apache | apache | 0.85 | {GRANT} apache (?:software )?{L}
mit-0 | attribution | 0.95 | {GRANT} mit no attribution(?: {L})?
mit | mit expat x11 | 0.95 | {GRANT} (?:mit x11|mit|expat|x11)(?: style)?(?: {L})?
isc | isc | 0.95 | {GRANT} isc(?: style)?(?: {L})?
0bsd | bsd 0bsd | 0.95 | {GRANT} (?:(?:0|zero) clause bsd|bsd (?:0|zero) clause|0bsd)(?: {L})?
bsd-2-clause | bsd freebsd | 0.95 | {GRANT} (?:(?:2|two) clause bsd|bsd (?:2|two) clause|simplified bsd|freebsd)(?: {L})?
bsd-3-clause | bsd | 0.95 | {GRANT} (?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: style)?(?: {L})?
bsd-4-clause | bsd | 0.95 | {GRANT} (?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)(?: {L})?
bsd | bsd | 0.9 | {GRANT} bsd(?: style)?(?: {L})?
mpl-2.0 | mozilla mpl | 0.95 | {GRANT} (?:mozilla public {L}|mpl) {V}2(?: 0)?
mpl-1.1 | mozilla mpl | 0.95 | {GRANT} (?:mozilla public {L}|mpl) {V}1 1
mpl | mozilla mpl | 0.85 | {GRANT} (?:mozilla public {L}|mpl)
epl-2.0 | eclipse epl | 0.95 | {GRANT} (?:eclipse public {L}|epl) {V}2(?: 0)?
epl-1.0 | eclipse epl | 0.95 | {GRANT} (?:eclipse public {L}|epl) {V}1(?: 0)?
eupl-1.2 | european eupl | 0.95 | {GRANT} (?:european union public {L}|eupl) {V}1 2
eupl-1.1 | european eupl | 0.95 | {GRANT} (?:european union public {L}|eupl) {V}1 1
cddl-1.0 | development cddl | 0.95 | {GRANT} (?:common development and distribution {L}|cddl)(?: {V}1(?: 0)?)?
artistic-2.0 | artistic | 0.95 | {GRANT} artistic {L} {V}2(?: 0)?
perl | perl | 0.9 | same terms as perl(?: 5)?(?: itself)?
ruby | ruby | 0.9 | same terms as ruby(?: itself)?
bsl-1.0 | boost | 0.95 | {GRANT} boost software {L}(?: {V}1(?: 0)?)?
zlib | zlib libpng | 0.95 | {GRANT} (?:zlib(?: libpng)?|libpng)(?: {L})?
psf-2.0 | python psf | 0.95 | {GRANT} (?:python software foundation|psf|python) {L}(?: {V}2)?
cc0-1.0 | cc0 zero | 0.95 | {GRANT} (?:creative commons )?(?:cc0|cc zero|zero)(?: {V}1 0)?(?: universal)?(?: public domain dedication)?
cc-by-4.0 | cc creative attribution | 0.95 | {GRANT} (?:a )?(?:cc by|creative commons attribution) (?:{L} )?{V}4 0(?: international)?(?: {L})?
cc-by-3.0 | cc creative attribution | 0.95 | {GRANT} (?:a )?(?:cc by|creative commons attribution) (?:{L} )?{V}3 0(?: unported| united states)?(?: {L})?
cc-by-sa-4.0 | cc creative sharealike | 0.95 | {GRANT} (?:a )?(?:cc by sa|creative commons attribution share ?alike) {V}4 0(?: international)?(?: {L})?
cc-by-sa-3.0 | cc creative sharealike | 0.95 | {GRANT} (?:a )?(?:cc by sa|creative commons attribution share ?alike) {V}3 0(?: unported)?(?: {L})?
cc-by-nc-4.0 | cc creative noncommercial | 0.95 | {GRANT} (?:a )?(?:cc by nc|creative commons attribution non ?commercial) {V}4 0(?: international)?(?: {L})?
ofl-1.1 | font ofl | 0.95 | {GRANT} (?:sil )?(?:open font {L}|ofl)(?: {V}1 1)?
odbl-1.0 | database odbl | 0.95 | {GRANT} (?:open data commons )?(?:open database {L}|odbl)(?: {V}1 0)?
gpl-3.0 | gnu | 0.9 | gnu org licenses gpl 3 0(?: (?:en )?(?:html|txt))?
gpl-2.0 | gnu | 0.9 | gnu org licenses (?:old licenses )?gpl 2 0(?: (?:en )?(?:html|txt))?
lgpl-3.0 | gnu | 0.9 | gnu org licenses lgpl 3 0(?: (?:en )?(?:html|txt))?
lgpl-2.1 | gnu | 0.9 | gnu org licenses (?:old licenses )?lgpl 2 1(?: (?:en )?(?:html|txt))?
agpl-3.0 | gnu | 0.9 | gnu org licenses agpl 3 0(?: (?:en )?(?:html|txt))?
gfdl | gnu | 0.9 | gnu org licenses fdl(?: 1 3)?(?: (?:en )?(?:html|txt))?
gpl | gnu | 0.7 | gnu org licenses(?: gpl)?(?: html)?
apache-2.0 | apache | 0.9 | apache org licenses {L} 2 0(?: (?:html|txt))?
mpl-2.0 | mozilla | 0.9 | mozilla org (?:en us )?mpl 2 0
mpl-1.1 | mozilla | 0.9 | mozilla org mpl (?:mpl )?1 1(?: html)?
epl-1.0 | eclipse | 0.9 | eclipse org legal epl v10(?: html)?
epl-2.0 | eclipse | 0.9 | eclipse org legal epl (?:2 0|v20)(?: html)?
bsl-1.0 | boost | 0.9 | boost org {L} 1 0 txt
ofl-1.1 | sil openfontlicense | 0.9 | (?:scripts sil org ofl|openfontlicense org)
unlicense | unlicense | 0.9 | unlicense org
wtfpl | wtfpl | 0.9 | wtfpl net
cc0-1.0 | creativecommons | 0.95 | creativecommons org publicdomain zero 1 0
public-domain | creativecommons | 0.9 | creativecommons org publicdomain mark 1 0
cc-by-4.0 | creativecommons | 0.95 | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons | 0.95 | creativecommons org licenses by 3 0
cc-by-2.5 | creativecommons | 0.95 | creativecommons org licenses by 2 5
cc-by-2.0 | creativecommons | 0.95 | creativecommons org licenses by 2 0
cc-by-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons | 0.95 | creativecommons org licenses by sa 3 0
cc-by-sa-2.5 | creativecommons | 0.95 | creativecommons org licenses by sa 2 5
cc-by-sa-2.0 | creativecommons | 0.95 | creativecommons org licenses by sa 2 0
cc-by-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nd 4 0
cc-by-nd-3.0 | creativecommons | 0.95 | creativecommons org licenses by nd 3 0
cc-by-nc-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc 4 0
cc-by-nc-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc 3 0
cc-by-nc-sa-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons | 0.95 | creativecommons org licenses by nc nd 3 0
mit | opensource spdx choosealicense | 0.9 | {OSI} mit(?: {L})?(?: (?:php|html))?
apache-2.0 | opensource spdx choosealicense | 0.9 | {OSI} apache(?: {L})? 2 0(?: (?:php|html))?
bsd-2-clause | opensource spdx choosealicense | 0.9 | {OSI} bsd 2 clause(?: html)?
bsd-3-clause | opensource spdx choosealicense | 0.9 | {OSI} bsd (?:3 clause|{L})(?: (?:php|html))?
isc | opensource spdx choosealicense | 0.9 | {OSI} isc(?: {L})?(?: txt| html)?
gpl-3.0 | opensource spdx choosealicense | 0.9 | {OSI} gpl 3 0(?: (?:only|or later))?(?: html)?
gpl-2.0 | opensource spdx choosealicense | 0.9 | {OSI} gpl 2 0(?: (?:only|or later))?(?: html)?
lgpl-2.1 | opensource spdx choosealicense | 0.9 | {OSI} lgpl 2 1(?: (?:only|or later))?(?: html)?
mpl-2.0 | opensource spdx choosealicense | 0.9 | {OSI} mpl 2 0(?: html)?
agpl-3.0 | opensource spdx choosealicense | 0.9 | {OSI} agpl 3 0(?: (?:only|or later))?(?: html)?
zlib | opensource spdx choosealicense | 0.9 | {OSI} zlib(?: {L})?(?: (?:php|html))?
"""

#: Sentences of the licenses themselves and of the notices that they ask for.
SENTENCES = r"""
gpl-3.0 | gnu | 0.9 | gnu general public {L} as published by the free software foundation either version 3 of the {L}(?: or at your option any later version)?
gpl-2.0 | gnu | 0.9 | gnu general public {L} as published by the free software foundation either version 2 of the {L}(?: or at your option any later version)?
gpl-2.0 | gnu | 0.9 | gnu general public {L} version 2 as published by the free software foundation
lgpl-2.1 | gnu | 0.9 | gnu lesser general public {L} as published by the free software foundation either version 2 1 of the {L}(?: or at your option any later version)?
lgpl-3.0 | gnu | 0.9 | gnu lesser general public {L} as published by the free software foundation either version 3 of the {L}(?: or at your option any later version)?
agpl-3.0 | gnu | 0.9 | gnu affero general public {L} as published by the free software foundation either version 3 of the {L}(?: or at your option any later version)?
gpl-3.0 | gnu | 0.9 | gnu general public {L} version 3 29 june 2007
gpl-2.0 | gnu | 0.9 | gnu general public {L} version 2 june 1991
gpl-1.0 | gnu | 0.9 | gnu general public {L} version 1 february 1989
lgpl-2.1 | gnu | 0.9 | gnu lesser general public {L} version 2 1 february 1999
lgpl-2.0 | gnu | 0.9 | gnu library general public {L} version 2 june 1991
lgpl-3.0 | gnu | 0.9 | gnu lesser general public {L} version 3 29 june 2007
agpl-3.0 | gnu | 0.9 | gnu affero general public {L} version 3 19 november 2007
gpl | redistribute | 0.7 | is free software you can redistribute it and or modify it under the terms of the gnu general public {L}
lgpl | redistribute | 0.7 | is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {L}
agpl | redistribute | 0.7 | is free software you can redistribute it and or modify it under the terms of the gnu affero general public {L}
gpl | gnu | 0.7 | you should have received a copy of the gnu general public {L} along with this (?:program|software|library|package|file)
lgpl | gnu | 0.7 | you should have received a copy of the gnu (?:lesser|library) general public {L} along with this (?:program|software|library|package|file)
agpl | gnu | 0.7 | you should have received a copy of the gnu affero general public {L} along with this (?:program|software|library|package|file)
gpl | licenses | 0.8 | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | copyleft | 0.8 | the gnu general public {L} is a free copyleft {L} for software and other kinds of works
gpl-3.0 | tivoization propagate | 0.7 | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
gpl | source | 0.6 | the source code for a work means the preferred form of the work for making modifications to it
lgpl | library | 0.6 | a work based on the library means either the library or any derivative work under copyright law
agpl-3.0 | remotely | 0.7 | all users interacting with it remotely through a computer network
gpl-classpath | exception | 0.8 | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-linking | exception | 0.7 | as a special exception (?:you may|the copyright holders|permission is)
gfdl | invariant | 0.8 | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
gfdl | document | 0.8 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L}
apache-2.0 | apache | 0.9 | apache {L} version 2 0 january 2004
apache-2.0 | compliance | 0.9 | you may not use this file except in compliance with the {L}
apache-2.0 | unless | 0.8 | unless required by applicable law or agreed to in writing software distributed under the {L} is distributed on an as is basis
apache-2.0 | perpetual | 0.7 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
apache | contributor | 0.8 | licensed to the apache software foundation asf under one or more contributor {L} agreements
apache-1.1 | apache | 0.8 | this product includes software developed by the apache software foundation
mit | permission | 0.9 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | merge sublicense | 0.8 | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | notice | 0.7 | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | noninfringement | 0.6 | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | liable | 0.6 | in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11 | advertising | 0.8 | except as contained in this notice the name of the [^ ]+(?: [^ ]+){0,3} shall not be used in advertising
isc | permission | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | disclaims | 0.6 | the software is provided as is and the author disclaims all warranties with regard to this software
hpnd | permission | 0.8 | permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose(?: and without fee)? is hereby granted
bsd | redistribution | 0.9 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2-clause | redistributions | 0.6 | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-2-clause | redistributions | 0.6 | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse | 0.8 | neither the name of(?: the)?(?: [^ ]+){1,12} may be used to endorse or promote products
bsd-3-clause | endorse | 0.8 | may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission
bsd-4-clause | advertising | 0.8 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | disclaimed | 0.5 | any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
mpl-2.0 | mozilla | 0.9 | this source code form is subject to the terms of the mozilla public {L} v(?:ersion)? 2 0
mpl-2.0 | mpl | 0.8 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | 0.9 | the contents of this file are subject to the mozilla public {L} version 1 1
mpl-1.1 | netscape | 0.8 | the contents of this file are subject to the netscape public {L}
mpl-1.1 | initial | 0.6 | the initial developer of the original code is
epl-1.0 | eclipse | 0.9 | the accompanying materials are made available under the terms of the eclipse public {L} v1 0
epl-2.0 | eclipse | 0.9 | the accompanying materials are made available under the terms of the eclipse public {L} 2 0
cpl-1.0 | common | 0.8 | the accompanying program is provided under the terms of this common public {L}
cddl | development | 0.9 | the contents of this file are subject to the terms of (?:either the gnu general public {L} version 2 only or )?the common development and distribution {L}
eupl | eupl | 0.8 | licensed under the eupl(?: version)? 1 [12](?: or as soon they will be approved)?
artistic | copied | 0.7 | the intent of this document is to state the conditions under which a package may be copied
bsl-1.0 | boost | 0.9 | distributed under the boost software {L} version 1 0
bsl-1.0 | obtaining | 0.8 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this {L}
zlib | altered | 0.8 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | misrepresented | 0.8 | the origin of this software must not be misrepresented
zlib | freely | 0.8 | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
unlicense | unencumbered | 0.9 | this is free and unencumbered software released into the public domain
unlicense | distribute | 0.8 | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | fuck | 0.9 | do what the fuck you want to public {L}
beerware | beer | 0.8 | if we meet some day and you think this stuff is worth it you can buy me a beer
beerware | beerware beer | 0.8 | the beer ?ware {L}
jsonlic | evil | 0.8 | the software shall be used for good not evil
ncsa | illinois | 0.8 | university of illinois(?: ncsa)? open source {L}
openssl | openssl | 0.8 | this product includes software developed by the openssl project
psf-2.0 | psf | 0.8 | this {L} agreement is between the python software foundation psf and the individual or organization
php-3.01 | php | 0.8 | this product includes php software freely available from
postgresql | postgresql california | 0.7 | in no event shall the university of california be liable to any party
ofl-1.1 | font | 0.9 | this font software is licensed under the sil open font {L} version 1 1
ofl-1.1 | font | 0.7 | the font software may be sold as part of a larger software package
cc | creative | 0.7 | this work is licensed under (?:a|the) creative commons
cc0-1.0 | dedicated waived | 0.9 | the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0 | waived | 0.8 | has waived all copyright and related or neighboring rights
public-domain | domain | 0.8 | (?:is|are|was|placed|released|dedicated) (?:hereby )?(?:in|into|to) the public domain
public-domain | copyright | 0.7 | no copyright is claimed(?: in)?
busl-1.1 | production | 0.8 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0 | service | 0.8 | if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0 | elastic managed | 0.8 | you may not provide the software to third parties as a hosted or managed service
commons-clause | commons | 0.8 | commons clause {L} condition
openrail | openrail rail responsible | 0.8 | (?:creativeml )?open ?rail(?: m| s)?(?: {L})?|open responsible ai {L}
"""

#: Names of licenses wherever they stand.
NAMES = r"""
gpl-3.0 | gnu gpl general gplv3 | 0.8 | (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}3(?: 0)?{LATER}
gpl-2.0 | gnu gpl general gplv2 | 0.8 | (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}2(?: 0)?{LATER}
gpl-1.0 | gnu gpl general gplv1 | 0.8 | (?:gnu )?(?:general public {L}(?: gpl)?|gpl) {V}1(?: 0)?{LATER}
gpl-3.0 | gplv3 gpl3 | 0.8 | (?:gnu )?gplv?3(?: 0)?{LATER}
gpl-2.0 | gplv2 gpl2 | 0.8 | (?:gnu )?gplv?2(?: 0)?{LATER}
lgpl-3.0 | lesser lgpl | 0.8 | (?:gnu )?(?:lesser general public {L}(?: lgpl)?|lgpl) {V}3(?: 0)?{LATER}
lgpl-2.1 | lesser lgpl | 0.8 | (?:gnu )?(?:lesser general public {L}(?: lgpl)?|lgpl) {V}2 1{LATER}
lgpl-2.0 | library lgpl | 0.8 | (?:gnu )?(?:library general public {L}(?: lgpl)?|lgpl) {V}2(?: 0)?{LATER}
lgpl-3.0 | lgplv3 lgpl3 | 0.8 | (?:gnu )?lgplv?3(?: 0)?{LATER}
lgpl-2.1 | lgplv2 lgpl2 | 0.8 | (?:gnu )?lgplv?2 1{LATER}
agpl-3.0 | affero agpl | 0.8 | (?:gnu )?(?:affero general public {L}(?: agpl)?|agpl) {V}3(?: 0)?{LATER}
agpl-1.0 | affero agpl | 0.8 | (?:affero general public {L}|agpl) {V}1(?: 0)?
agpl-3.0 | agplv3 agpl3 | 0.8 | (?:gnu )?agplv?3(?: 0)?{LATER}
gfdl-1.3 | documentation gfdl | 0.8 | (?:gnu )?(?:free documentation {L}|gfdl) {V}1 3{LATER}
gfdl-1.2 | documentation gfdl | 0.8 | (?:gnu )?(?:free documentation {L}|gfdl) {V}1 2{LATER}
gfdl-1.1 | documentation gfdl | 0.8 | (?:gnu )?(?:free documentation {L}|gfdl) {V}1 1{LATER}
lgpl | lesser library lgpl | 0.7 | (?:gnu )?(?:(?:lesser|library) general public {L}|lgpl)
agpl | affero agpl | 0.7 | (?:gnu )?(?:affero general public {L}|agpl)
gpl | gnu gpl general | 0.7 | (?:gnu )?(?:general public {L}|gpl)
gfdl | documentation gfdl | 0.7 | (?:gnu )?(?:free documentation {L}|gfdl)
apache-2.0 | apache | 0.8 | apache (?:software )?(?:{L} )?{V}2(?: 0)?(?: {L})?
apache-1.1 | apache | 0.8 | apache (?:software )?{L} {V}1 1
apache | apache | 0.7 | apache (?:software )?{L}
mit-0 | attribution | 0.8 | mit no attribution(?: {L})?
mit | mit expat | 0.8 | (?:mit x11|mit|expat) {L}
x11 | x11 | 0.8 | x11 {L}
isc | isc | 0.8 | isc {L}
0bsd | bsd 0bsd | 0.8 | (?:(?:0|zero) clause bsd|bsd (?:0|zero) clause|0bsd)(?: {L})?
bsd-2-clause | bsd | 0.8 | (?:(?:2|two) clause bsd|bsd (?:2|two) clause|(?:simplified|freebsd) bsd)(?: {L})?
bsd-3-clause | bsd | 0.8 | (?:(?:3|three) clause bsd|bsd (?:3|three) clause|(?:new|modified|revised) bsd)(?: {L})?
bsd-4-clause | bsd | 0.8 | (?:(?:4|four) clause bsd|bsd (?:4|four) clause|original bsd)(?: {L})?
bsd | bsd | 0.8 | bsd(?: style)? {L}
mpl-2.0 | mozilla mpl | 0.8 | (?:mozilla public {L}|mpl) {V}2(?: 0)?
mpl-1.1 | mozilla mpl | 0.8 | (?:mozilla public {L}|mpl) {V}1 1
mpl | mozilla | 0.7 | mozilla public {L}
epl-2.0 | eclipse epl | 0.8 | (?:eclipse public {L}|epl) {V}2(?: 0)?
epl-1.0 | eclipse epl | 0.8 | (?:eclipse public {L}|epl) {V}1(?: 0)?
edl-1.0 | eclipse | 0.8 | eclipse distribution {L}(?: {V}1 0)?
eupl-1.2 | european eupl | 0.8 | (?:european union public {L}|eupl) {V}1 2
eupl-1.1 | european eupl | 0.8 | (?:european union public {L}|eupl) {V}1 1
cddl-1.1 | cddl | 0.8 | cddl {V}1 1
cddl-1.0 | development cddl | 0.8 | (?:common development and distribution {L}|cddl)(?: {V}1(?: 0)?)?
cpl-1.0 | common | 0.8 | common public {L}(?: {V}1(?: 0)?)?
ibm-pl | ibm | 0.8 | ibm public {L}(?: {V}1 0)?
artistic-2.0 | artistic | 0.8 | artistic {L} {V}2(?: 0)?
artistic-1.0 | artistic | 0.7 | artistic {L}
bsl-1.0 | boost | 0.8 | boost software {L}(?: {V}1(?: 0)?)?
zlib | zlib | 0.8 | zlib(?: libpng)? {L}
libpng | libpng | 0.8 | libpng {L}
unlicense | unlicense | 0.8 | the unlicense
psf-2.0 | python psf | 0.8 | (?:python software foundation|psf) {L}(?: {V}2)?
postgresql | postgresql | 0.8 | postgresql {L}
openssl | openssl | 0.8 | openssl {L}
php-3.01 | php | 0.8 | php {L}(?: {V}3(?: 0?1)?)?
ruby | ruby | 0.8 | ruby {L}
vim | vim | 0.8 | vim {L}
qpl-1.0 | license licence | 0.8 | q(?:t)? public {L}(?: {V}1 0)?
w3c | w3c | 0.8 | w3c software (?:notice and )?{L}
unicode | unicode | 0.8 | unicode (?:data files and software )?{L}(?: {V}3)?
ofl-1.1 | font | 0.8 | (?:sil )?open font {L}(?: {V}1 1)?
odbl-1.0 | database odbl | 0.8 | (?:open database {L}|odbl)(?: {V}1(?: 0)?)?
odc-by-1.0 | commons | 0.8 | open data commons attribution {L}
pddl-1.0 | dedication pddl | 0.8 | (?:public domain dedication and {L}|pddl)
ogl-uk-3.0 | government | 0.8 | open government {L}(?: {V}3 0)?
etalab-2.0 | etalab license licence | 0.8 | (?:etalab )?(?:open {L}|licence ouverte) (?:etalab )?{V}2 0
ms-pl | microsoft | 0.8 | microsoft public {L}
ms-rl | microsoft | 0.8 | microsoft reciprocal {L}
busl-1.1 | business | 0.8 | business source {L}(?: {V}1 1)?
sspl-1.0 | server sspl | 0.8 | (?:server side public {L}|sspl)(?: {V}1)?
elastic-2.0 | elastic | 0.8 | elastic {L}(?: {V}2(?: 0)?)?
polyform | polyform | 0.8 | polyform (?:noncommercial|shield|perimeter|strict|small business|free trial|internal use|defensive) {L}(?: 1 0 0)?
llama | llama | 0.8 | llama [234](?: [123])? community {L}(?: agreement)?
cecill | cecill | 0.8 | cecill(?: [bc])?(?: {L})?(?: {V}2(?: [01])?)?
mulan | mulan | 0.8 | mulan (?:permissive software|public) {L}(?: {V}[12])?
cc0-1.0 | cc0 cc creative | 0.8 | (?:cc0|cc zero|creative commons zero)(?: {V}1 0)?(?: universal)?
cc-by-nc-nd-4.0 | cc creative | 0.8 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?) {V}4 0(?: international)?
cc-by-nc-nd-3.0 | cc creative | 0.8 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?) {V}3 0(?: unported)?
cc-by-nc-sa-4.0 | cc creative | 0.8 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) {V}4 0(?: international)?
cc-by-nc-sa-3.0 | cc creative | 0.8 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) {V}3 0(?: unported)?
cc-by-nc-4.0 | cc creative | 0.8 | (?:cc by nc|creative commons attribution non ?commercial) {V}4 0(?: international)?
cc-by-nc-3.0 | cc creative | 0.8 | (?:cc by nc|creative commons attribution non ?commercial) {V}3 0(?: unported)?
cc-by-nd-4.0 | cc creative | 0.8 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?) {V}4 0(?: international)?
cc-by-nd-3.0 | cc creative | 0.8 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?) {V}3 0(?: unported)?
cc-by-sa-4.0 | cc creative | 0.8 | (?:cc by sa|creative commons attribution share ?alike) {V}4 0(?: international)?
cc-by-sa-3.0 | cc creative | 0.8 | (?:cc by sa|creative commons attribution share ?alike) {V}3 0(?: unported)?
cc-by-sa-2.5 | cc creative | 0.8 | (?:cc by sa|creative commons attribution share ?alike) {V}2 5
cc-by-sa-2.0 | cc creative | 0.8 | (?:cc by sa|creative commons attribution share ?alike) {V}2 0
cc-by-4.0 | cc creative | 0.8 | (?:cc by|creative commons attribution)(?: {L})? {V}4 0(?: international)?
cc-by-3.0 | cc creative | 0.8 | (?:cc by|creative commons attribution)(?: {L})? {V}3 0(?: unported)?
cc-by-2.5 | cc creative | 0.8 | (?:cc by|creative commons attribution)(?: {L})? {V}2 5
cc-by-2.0 | cc creative | 0.8 | (?:cc by|creative commons attribution)(?: {L})? {V}2 0
cc-by-nc-nd | cc creative | 0.7 | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)(?: {L})?
cc-by-nc-sa | cc creative | 0.7 | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: {L})?
cc-by-nc | cc creative | 0.7 | (?:cc by nc|creative commons attribution non ?commercial)(?: {L})?
cc-by-nd | cc creative | 0.7 | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)(?: {L})?
cc-by-sa | cc creative | 0.7 | (?:cc by sa|creative commons attribution share ?alike)(?: {L})?
cc-by | cc creative | 0.7 | (?:cc by|creative commons attribution)(?: {L})?
copyright | copyright | 0.6 | copyright (?:c )?(?:by )?(?:19|20)\d\d(?: (?:19|20)\d\d)*
copyright | copyright | 0.4 | copyright (?:holders?|owners?|notice)
reserved | reserved | 0.6 | (?:all|some|no) rights reserved
proprietary | proprietary | 0.7 | (?:proprietary and confidential|confidential and proprietary)
proprietary | unauthorized | 0.7 | unauthorized (?:copying|reproduction|use|distribution) of this (?:file|software|document|material)(?: via any medium)? is strictly prohibited
proprietary | license licence | 0.7 | end user {L} agreement
proprietary | evaluation | 0.6 | for (?:internal )?evaluation purposes only
no-commercial | commercial noncommercial | 0.6 | for (?:personal and )?non ?commercial use only
no-warranty | warranty | 0.5 | (?:provided )?as is without warranty(?: of any kind)?
no-warranty | warranties | 0.5 | without (?:any )?warranties or conditions of any kind
"""


def rules() -> list[dict]:
    """All rules in order: rule, label, keys (one must occur), regex, priority (1 is best), weight."""
    out = []
    for priority, table in enumerate((TAGS, GRANTS, SENTENCES, NAMES), 1):
        for line in table.strip().split("\n"):
            label, keys, weight, pattern = line.split(" | ", 3)
            for short, full in _SHORT.items():
                pattern = pattern.replace(short, full)
            out.append({"rule": len(out), "label": label, "keys": keys.split(), "regex": f"(?<= )(?:{pattern})(?= )", "priority": priority, "weight": float(weight)})
    return out
