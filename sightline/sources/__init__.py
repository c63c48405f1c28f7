"""sightline.sources"""
