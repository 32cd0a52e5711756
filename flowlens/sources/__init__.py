"""flowlens.sources"""
