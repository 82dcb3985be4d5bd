"""Standard notices are named by their own licence, not by the nearest relative."""

import pytest

from scatterwave.llm import licences

NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. %sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "


@pytest.mark.parametrize("text, licence", [(NOTICE % "", "GPL-3.0"), (NOTICE % "Affero ", "AGPL-3.0"), (NOTICE % "Lesser ", "LGPL-3.0"), (BSD % "", "BSD-2-Clause"), (BSD % THIRD, "BSD-3-Clause")])
def test_relatives_are_told_apart(text, licence):
    for edited in (text, text.replace("and/or", "or", 1).replace("must", "shall", 1)):
        assert {m[0] for m in licences.Matcher().passages(f"alpha beta {edited} gamma")} == {licence}


@pytest.mark.parametrize("licence", sorted(licences.TEMPLATES))
def test_every_template_names_its_licence(licence):
    assert all([m[0] for m in licences.Matcher().passages(t)] == [licence] for t in licences.TEMPLATES[licence])
