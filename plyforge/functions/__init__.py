"""Part of plyforge; see the README for the layout."""
