"""cardloom: link cards, page metadata and text preparation as Spark plans."""
