"""Web-media analytics on Spark: pages in, ranked media and link tables out."""
